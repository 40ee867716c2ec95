import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import fetch, pack, render
from spanloom.plans import metrics
from spanloom.plans.options import Options
from spanloom.plans.patterns import anchored, java_regex
from spanloom.plans.search import search
from spanloom.sources import corpus

TREE = {
    "src/auth.py": 'import db\n"""def fake():"""\n\n\ndef validate_token(token):\n    return db.find(token)\n\n\ndef refresh(token):\n    return validate_token(token)\n',
    "src/api.py": "from auth import validate_token\n\n\ndef handler(request):\n    if not validate_token(request.token):\n        raise ValueError\n    return 1\n",
    "vendor/copy.py": "def validate_token(token):\n    return True\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(list(TREE.items()), "path string, content string").cache()


def anchors(result):
    return [f"{r.path}:{r.start_line}-{r.end_line}" for r in result.spans.collect()]


def test_golden(tree):
    got = search(tree, ["validate_token"], Options(word=True, max_tokens=1000, explain=True)).spans.collect()
    assert [(f"{r.path}:{r.start_line}-{r.end_line}", r.symbol, r.is_declaration, r.match_lines, round(r.score, 6)) for r in got] == [
        ("src/auth.py:5-6", "validate_token", True, [5], 2.193147),
        ("vendor/copy.py:1-2", "validate_token", True, [1], 2.193147),
        ("src/api.py:1-7", "handler", False, [1, 5], 2.598612),
        ("src/auth.py:9-10", "refresh", False, [10], 2.193147),
    ]
    for r in got:
        assert r.text == "\n".join(TREE[r.path].split("\n")[r.start_line - 1 : r.end_line])
        assert abs(r.why.matches + r.why.terms + r.why.path - r.why.depth_penalty - r.score) < 1e-9


def test_selection(tree):
    assert anchors(search(tree, ["validate_token"], Options(select="declarations"))) == ["src/auth.py:5-6", "vendor/copy.py:1-2"]
    assert anchors(search(tree, ["validate_token"], Options(select="references"))) == ["src/api.py:1-7", "src/auth.py:9-10"]
    assert anchors(search(tree, ["validate_token"], Options(globs=("!vendor/**",), kinds=("def",)))) == ["src/auth.py:5-6"]
    assert search(tree, ["nothing here"]).exit_status == 1
    assert anchors(search(tree, ["validate_token"], Options(paths=()))) == []
    assert anchors(search(tree, ["validate_token"], Options(paths=("./src/api.py",)))) == ["src/api.py:1-7"]


def test_several_patterns(tree):
    found = search(tree, ["handler", "refresh", "zebra"], Options())
    got = found.spans.collect()
    assert {got[0]["query"], got[1]["query"]} == {"handler", "refresh"} and found.unmatched == ["zebra"]


def test_budget_and_cap(spark):
    many = "".join(f"def handler_{i}(x):\n    return {i}\n\n" for i in range(8))
    files = spark.createDataFrame([("m.py", many)], "path string, content string")
    assert len(anchors(search(files, ["handler"], Options(max_tokens=None)))) == 8
    assert len(anchors(search(files, ["handler"], Options(max_per_file=2)))) == 2
    got = search(files, ["handler"], Options(max_tokens=30, max_per_file=0)).spans.collect()
    assert got and sum(r.tokens for r in got) <= 30
    runs = {tuple(anchors(search(files.repartition(n), ["handler"], Options(max_tokens=30)))) for n in (1, 3)}
    assert len(runs) == 1
    found = search(files, ["handler"], Options(max_tokens=30))
    before = anchors(found)
    assert found.held and all(df.is_cached for df in found.held)
    held = list(found.held)
    found.release()
    assert not any(df.is_cached for df in held) and anchors(found) == before


def test_min_references():
    rows = [("a", 5, True), ("b", 5, True), ("c", 5, False)]
    assert pack.fill(rows, 10, 0) == [0, 1]
    assert pack.fill_with_references(rows, 10, 0, 1) == [0, 2]
    assert pack.fill_with_references(rows, 10, 0, 2) == [0, 1]


def test_floor_by_brute_force(monkeypatch):
    """Refills that go on from where a declaration gave way give what whole ones give, whatever the size of a page."""
    rng = random.Random(9)

    def whole(rows, most, cap, floor):
        barred, plain = set(), None
        while True:
            taken = pack.fill(rows, most, cap, frozenset(barred))
            plain = taken if plain is None else plain
            if sum(not rows[i][2] for i in taken) >= floor:
                return taken
            last = next((i for i in reversed(taken) if rows[i][2]), None)
            if last is None:
                return plain
            barred.add(last)

    for _ in range(300):
        rows = [(rng.choice("abc"), rng.randrange(1, 9), rng.random() < 0.6) for _ in range(rng.randrange(14))]
        most, cap, floor = rng.randrange(1, 30), rng.randrange(4), rng.randrange(5)
        for page in (1, 3, 100):
            monkeypatch.setattr(pack, "AT_ONCE", page)
            assert pack.fill_with_references(rows, most, cap, floor) == whole(rows, most, cap, floor)


def test_any_size(spark, monkeypatch):
    """The plans for more candidates and spans than one task or the driver may hold give what the plain ones give."""
    from spanloom.functions import tables as T

    text = lambda i: "".join(f"def {'rare' if i == 7 else 'handler'}_{i}_{k}(x):\n    return {'handler' * (k % 3)}\n\n" for k in range(1 + i % 5))
    files = spark.createDataFrame([(f"m{i}.py", text(i)) for i in range(24)], "path string, content string").repartition(3)
    cases = [(["handler", "rare"], Options(max_tokens=400)), (["handler", "none"], Options(max_tokens=300, min_references=2)), (["handler", "x"], Options(max_tokens=None))]
    run = lambda p, o: [(f"{r.path}:{r.start_line}-{r.end_line}", r["query"], r["tokens"]) for r in search(files, p, o).spans.collect()]
    plain = [run(p, o) for p, o in cases]
    for wide, chunk, page in ((16384, 8, 1 << 16), (0, 8, 7)):
        monkeypatch.setattr(T, "WIDE", wide)
        monkeypatch.setattr(T, "CHUNK", chunk)
        monkeypatch.setattr(pack, "AT_ONCE", page)
        for (p, o), want in zip(cases, plain, strict=True):
            assert run(p, o) == want, (wide, page, p)


def test_hostile_content(spark):
    odd = [("a.py", "x\0def token(): pass\n"), ("b.py", "token\r\ntoken"), ("c.py", ""), ("d.py", "\ufefftoken = 1"), ("e.py", "\n" * 2000 + "token"), ("f.py", "token " * 50_000), ("g.py", "日本 token\n")]
    files = spark.createDataFrame(odd, "path string, content string")
    for o in (Options(max_tokens=None, columns=True), Options(comments_only=True), Options(select="declarations"), Options(literal=True, word=True, ignore_case=True)):
        got = search(files, ["token"], o).spans.collect()
        assert "a.py" not in {r.path for r in got}
    cols = {r.path: r.match_columns[0] for r in search(files, ["token"], Options(max_tokens=None, columns=True)).spans.collect()}
    assert cols["g.py"] == 8 and cols["d.py"] == 4


def test_options_conflict():
    for bad in ({"kinds": ("fn",), "select": "references"}, {"min_references": 1, "select": "declarations"}, {"tests": "some"}):
        with pytest.raises(ValueError):
            Options(**bad)
    with pytest.raises(ValueError):
        java_regex("(?=x)", Options())
    with pytest.raises(ValueError):
        X.extensions(["klingon"])


def test_identifiers_by_rule(spark):
    """Names put together from words fall apart into them, in every style."""
    rng = random.Random(6)
    words = ["apple", "pear", "quince", "über", "fig"]
    for _ in range(60):
        parts = rng.choices(words, k=rng.randrange(1, 5))
        n = str(rng.randrange(100))
        for name in ("".join(w.title() for w in parts) + n, "_".join(parts) + "-" + n, "__" + parts[0] + "".join(w.title() for w in parts[1:]) + "__" + n, parts[0].upper() + n + "".join(w.title() for w in parts[1:])):
            whole = [parts[0], n, *parts[1:]] if name.startswith(parts[0].upper() + n) else [*parts, n]
            assert X.identifier_tokens(name) == whole, name
            assert spark.range(1).select(X.identifier_parts(F.lit(name))).first()[0] == whole


def test_test_files_by_rule(spark):
    """Folders, stems, and what stems begin or end with; words that only contain these are no tests."""
    from spanloom.functions import tables as T

    yes = [f"a/{d}/b.c" for d in T.TEST_DIRS] + [f"{d.upper()}/b" for d in T.TEST_DIRS] + [f"a/{s}.c" for s in T.TEST_STEMS] + [f"a/pear{e}.c" for e in T.TEST_ENDINGS] + [f"a/{s}pear.c" for s in T.TEST_STARTS] + [f"a/Pear{c}.c" for c in T.TEST_CAMEL]
    no = [f"a/x{d}/b.c" for d in T.TEST_DIRS] + [f"a/{d}x/b.c" for d in T.TEST_DIRS] + [f"a/pear{c.lower()}.c" for c in T.TEST_CAMEL] + ["a/b.test", "a/pear.c", "tests.c/../x"][:2]
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    got = {r[0] for r in df.filter(X.looks_like_test(F.col("path"))).collect()}
    assert got == set(yes)


def test_patterns():
    for pattern, regex in {"[[:digit:]x]+": "(?dU)[0-9x]+", r"\p{Greek}\PL": r"(?dU)\p{IsGreek}\P{L}", "(?P<one>a)(?<two>b)": "(?dU)(?:a)(?:b)", r"\v": r"(?dU)\x0B", "(?i)a(?-i:b)": "(?dU)(?iu)a(?-iu:b)", r"[^]a[b]&&c]": r"(?dU)[^\]a[b]&&c]", r"\u{1F600}": r"(?dU)\x{1F600}", "a{,3}": "(?dU)a{0,3}"}.items():
        assert java_regex(pattern, Options()) == regex
    for bad in ("(?=x)", "(?!x)", "(?<=x)", "a++", "a{2}+", r"(a)\1", r"\k<n>", r"\Z", r"\Qx\E", r"[\w--x]", "[[:nope:]]", "(?R)a"):
        with pytest.raises(ValueError):
            java_regex(bad, Options())
    assert [anchored(p) for p in ("a", "^a", "a$", r"\^a", "[^a]", r"a\z", r"[$]\$")] == [False, True, True, False, False, True, False]


def test_edges_of_lines(spark):
    """Separators that end no line, and comments whose code is blanked."""
    files = spark.createDataFrame([("u", "a\u2028b\u0085\na\rb\n"), ("c", "x = 1;//foo\n"), ("r", "abc\r\r\nabc\r\nabc\r")], "path string, content string")
    hits = lambda p, **o: {(r.path, n) for r in search(files, [p], Options(max_tokens=None, **o)).spans.collect() for n in r.match_lines}
    assert hits("a.b") == {("u", 1), ("u", 2)} and hits("b$") == {("u", 2)}
    assert hits(" //foo", comments_only=True) == {("c", 1)} and hits(" //foo") == set()
    assert hits("c$") == {("r", 2), ("r", 3)} and hits("\r$") == {("r", 1)}


def test_rows_without_a_path_of_their_own(spark):
    """Files are rows: equal or null paths keep apart, with and without a budget; equal rows count once under one."""
    rows = [("a", "pear\n"), ("a", "\n" * 20 + "pear\n"), (None, "pear 2\n"), (None, "pear 2\n")]
    files = spark.createDataFrame(rows, "path string, content string")
    got = lambda **o: sorted((str(r.path), r.start_line, r.text.strip()) for r in search(files, ["pear"], Options(**o)).spans.collect())
    assert got(max_tokens=None) == [("None", 1, "pear 2"), ("None", 1, "pear 2"), ("a", 1, "pear"), ("a", 15, "pear")]
    assert set(got(max_tokens=500)) == {("None", 1, "pear 2"), ("a", 1, "pear"), ("a", 15, "pear")}


def test_long_contents_are_fetched(spark, monkeypatch):
    """Contents too long to travel with their rank come from the files."""
    from spanloom.functions import tables as T

    files = spark.createDataFrame([(f"f{i}", "pear\n" * (i + 1)) for i in range(30)], "path string, content string")
    run = lambda: [(r.path, r.start_line, r.end_line) for r in search(files, ["pear"], Options(max_tokens=300)).spans.collect()]
    plain = run()
    monkeypatch.setattr(T, "CARRIED", 40)
    assert run() == plain


def test_fetch(tree):
    got = fetch.fetch(tree, ["src/api.py:4-99", "vendor/copy.py:1-1", "vendor/copy.py:1-1"]).collect()
    assert [(r["query"], r.end_line) for r in got] == [("src/api.py:4-7", 7), ("vendor/copy.py:1-1", 1), ("vendor/copy.py:1-1", 1)]
    for bad in ("/etc/passwd:1-1", "../x:1-1", "src/api.py:9-5", "src/api.py:50-60", "nothing"):
        with pytest.raises(ValueError):
            fetch.fetch(tree, [bad])
    assert fetch.anchors_from("a:1-2 rest\n\n b:3-4\n") == ["a:1-2", "b:3-4"]


def test_render(tree):
    spans = search(tree, ["validate_token"], Options(columns=True, explain=True)).spans.cache()
    shown = render.to_text(spans, why=True)
    assert shown.startswith("src/auth.py:5-6 (def validate_token) [") and "matches 0.69 + terms 1.50" in shown and shown.endswith("\n") and not shown.endswith("\n\n")
    assert "     5:def validate_token(token):" in render.to_text(spans, line_numbers=True)
    lines = [r.rendered for r in render.vimgrep(spans, "root").collect()]
    assert lines == sorted(lines, key=lambda x: x.split(":")[0]) and lines[0] == "root/src/api.py:1:18:from auth import validate_token"
    assert [x["path"] for x in json.loads(render.to_json(spans))] == [r.path for r in spans.collect()]
    assert "spans" in render.stats(spans, 2000)


def test_tree_source(spark, tmp_path):
    for name, data in {"a.py": b"def token(): pass\n", ".hid/b.py": b"token", "skip/c.py": b"token", "bad.py": b"\xff token", ".gitignore": b"skip/\n", "sub/d.txt": b"token"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    paths = lambda **k: sorted(r.path for r in corpus.from_tree(spark, str(tmp_path), **k).collect())
    assert paths() == ["a.py", "sub/d.txt"]
    assert paths(no_ignore=True) == ["a.py", "skip/c.py", "sub/d.txt"]
    assert ".hid/b.py" in paths(hidden=True)
    assert paths(paths=["skip/c.py", "none"]) == ["skip/c.py"] and paths(paths=[]) == []
    with pytest.raises(FileNotFoundError):
        corpus.from_tree(spark, str(tmp_path / "nowhere"))


def test_ignore_files_above(tmp_path, monkeypatch):
    """What the folders above a root and the user's own excludes leave out, within a repository."""
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    root = tmp_path / "repo/sub/tree"
    for name, text in {"home/git/ignore": "*.mine\n", "repo/.git/info/exclude": "out/\n", "repo/.gitignore": "sub/tree/gone.py\n*.tmp\n", "repo/sub/.ignore": "tree/quiet.py\n!kept.tmp\n", ".gitignore": "*\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for name in ("a.py", "gone.py", "quiet.py", "b.tmp", "kept.tmp", "c.mine", "out/d.py", "deep/gone.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    assert corpus.list_tree(str(root))[0] == ["a.py", "kept.tmp", "deep/gone.py"]
    assert corpus.list_tree(str(root), no_ignore=True)[0] == ["a.py", "b.tmp", "c.mine", "gone.py", "kept.tmp", "deep/gone.py", "out/d.py"]


def test_git_source(tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a").write_text("1")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a").write_text("2")
    (tmp_path / "b").write_text("new")
    assert corpus.changed_since(str(tmp_path), "HEAD") == ["a", "b"]
    with pytest.raises(ValueError):
        corpus.changed_since(str(tmp_path), "no-such-branch")


def test_stream(spark, tmp_path):
    from spanloom.streaming.scout import scout_stream, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("def token():\n    pass\n")
    q = scout_stream(watch(spark, str(tmp_path / "in")), ["token"]).writeStream.format("memory").queryName("scouted").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.match_count, r.declaration_hint) for r in spark.table("scouted").collect()] == [(1, True)]


def test_metrics(spark):
    assert metrics.bootstrap_median([1.0, 2.0, 3.0])[0] <= 2 <= metrics.bootstrap_median([1.0, 2.0, 3.0])[1]


def test_vocabulary(spark, tmp_path):
    import base64

    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)) + base64.b64encode(b"ab") + b" 256\n")
    assert spark.createDataFrame([("abab c",)], "t string").select(X.bpe_counter(str(path))("t")).first()[0] == 4
