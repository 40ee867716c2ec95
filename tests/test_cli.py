import io
import json

import pytest

from spanloom.cli import main

TREE = {
    "src/auth.py": "import db\n\n\ndef validate_token(token):\n    return db.find(token)\n\n\ndef refresh(token):\n    return validate_token(token)\n",
    "vendor/copy.py": "# by hand\ndef validate_token(token):\n    return True\n",
    "big.txt": "x" * (8 * 1024 * 1024 + 1),
    ".hid/a.py": "validate_token\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    return str(base)


def call(spark, *argv, given=""):
    out, err = io.StringIO(), io.StringIO()
    return main(list(argv), spark, io.StringIO(given), out, err), out.getvalue(), err.getvalue()


def test_search_and_forms(spark, root):
    code, out, err = call(spark, "validate_token", root, "-w", "--stats")
    assert code == 0 and out.startswith("src/auth.py:4-5 (def validate_token)") and "skipped 1 files over 8 MiB" in err
    assert "3 spans" in err and "(2 files matched)" in err and "(2 files read)" in err
    code, out, _ = call(spark, "validate_token", root, "-l", "-r")
    assert code == 0 and out.split()[0] == "src/auth.py:8-9" and "\n\n" not in out
    code, out, _ = call(spark, "validate_token", root, "--vimgrep", "-t", "python")
    assert [x.split(":")[1:3] for x in out.splitlines()] == [["4", "5"], ["9", "12"], ["2", "5"]] and out.startswith(root)
    code, out, _ = call(spark, "-e", "refresh", "-e", "zebra", root, "--json", "--why")
    assert code == 0 and {"path", "why", "text"} <= json.loads(out)[0].keys()


def test_scopes(spark, root, tmp_path):
    (tmp_path / "list").write_bytes(b"vendor/copy.py\0./src/none.py\0")
    assert call(spark, "validate_token", root, "--files-from", str(tmp_path / "list"), "-0", "-l")[1].startswith("vendor/copy.py:2-3")
    assert call(spark, "validate_token", root, "--files-from", "-", "-l", given="src/auth.py\n")[1].startswith("src/auth.py:4-5")
    assert call(spark, "validate_token", root, "--files-from", "-", given="")[0] == 1
    assert call(spark, "validate_token", root, "--hidden", "-g", ".hid/**", "-l")[1].startswith(".hid/a.py:1-1")
    assert call(spark, "by hand", root, "-C", "-l")[0] == 0
    code, out, err = call(spark, "validate_token", root, "--kind", "struct,class")
    assert (code, out) == (1, "") and "nothing of that kind" in err


def test_fetch(spark, root):
    code, out, _ = call(spark, "--fetch", "src/auth.py:4-5", "--fetch", "-", root, given="vendor/copy.py:1-1 rest\n")
    assert code == 0 and out.index("src/auth.py:4-5") < out.index("vendor/copy.py:1-1") and "# by hand" in out
    for bad in ("../x:1-1", "src/auth.py:50-60", "src/gone.py:1-2", "nothing"):
        assert call(spark, "--fetch", bad, root)[0] == 2


def test_failures(spark, root):
    for bad in ((), ("x", root + "/nowhere"), ("(", root), ("x", root, "-t", "klingon"), ("-e", "a", root, "b"), ("x", root, "-d", "-r"), ("x", root, "-b", "5", "-a"), ("x", root, "--json", "--vimgrep"), ("x", root, "-0"), ("x", root, "--min-references", "2", "-d"), ("x", root, "--kind", "fn", "-r")):
        assert call(spark, *bad)[0] == 2, bad
    code, out, _ = call(spark, "no-such-thing", root, "--json")
    assert code == 1 and json.loads(out) == []
