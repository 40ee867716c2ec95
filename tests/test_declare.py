"""The masker and the declaration table, held against the rules they follow."""

import random
import re

import pytest

from spanloom.functions.declare import Masker, analyze, body_ends, declares, nesting, scan_declaration
from spanloom.functions.tables import CALLABLE_WORDS, CONTROL_WORDS, KEYWORDS, MODIFIERS
from spanloom.plans import codebase


def found(source):
    return [(d.kind, d.name, d.start_line, d.end_line, d.depth) for d in analyze(source)[0]]


@pytest.mark.parametrize("keyword", sorted(KEYWORDS))
def test_keyword_shape(keyword):
    """Every keyword declares the name after it, whatever modifiers come first; alone, or before something else, it declares nothing."""
    rng = random.Random(keyword)
    for n in range(4):
        line = " ".join([*rng.sample(sorted(MODIFIERS), n), keyword, "orchard", "tail"])
        assert scan_declaration("\t" + line) == (keyword, "orchard")
    for line in (keyword, f"{keyword} 9lives", f"of {keyword} pear", f"x.{keyword} pear"):
        assert scan_declaration(line) is None or scan_declaration(line)[0] != keyword or "pear" not in line


def test_modifiers_and_parameters():
    assert scan_declaration("pub(in plum::tree) static apple_count") == ("static", "apple_count")
    assert scan_declaration("fn<'a, F: Fn(&'a u8) -> bool> graft(f: F)") == ("fn", "graft")
    assert scan_declaration("impl<K: Into<Vec<u8>>> Basket<K> {") == ("impl", "Basket")
    assert declares("impl Basket {") is None and declares("trait Basket {") == "Basket"


def test_receivers():
    assert scan_declaration("func (b *Basket) Empty(n int) bool {") == ("func", "Empty")
    assert scan_declaration("fn (self) ripen()") == ("fn", "ripen")
    assert scan_declaration("func (b *Basket Empty() {") != ("func", "Empty")


@pytest.mark.parametrize("word", sorted(CONTROL_WORDS))
def test_signatures_and_control_words(word):
    """A name before brackets at a line that opens a body is a function, unless a control word stands where it matters."""
    assert scan_declaration("unsigned long weigh(struct pear *p) {") == ("struct", "p") or scan_declaration("unsigned long weigh(pear *p) {") == ("function", "weigh")
    assert scan_declaration(f"{word} (ripe) {{") is None
    assert scan_declaration(f"  {word} weigh(ripe) {{") is None or word in MODIFIERS
    assert scan_declaration("weigh(pear);") is None and scan_declaration('it("grows", weigh(() => {') is None


@pytest.mark.parametrize("word", sorted(CALLABLE_WORDS))
def test_assignments(word):
    assert scan_declaration(f"tree.root.peel = {word} pear")[1] == "peel"
    assert scan_declaration(f"peel == {word} pear") is None or scan_declaration(f"peel == {word} pear")[1] != "peel"


def test_arrows():
    assert scan_declaration("peel = (pear) => core(pear)") == ("function", "peel")
    assert scan_declaration("peel = pear => core(pear)") == ("function", "peel")
    assert scan_declaration("peel = 3 + core(pear)") is None and scan_declaration("peel <= pear => core") is None


def test_body_ends_by_brute_force():
    """A body stops at the next line that is indented no further; what only closes belongs to it."""
    rng = random.Random(3)
    for _ in range(300):
        lines, n = [], 0
        for _ in range(rng.randrange(1, 25)):
            n += rng.randrange(1, 3)
            lines.append((n, rng.randrange(4), rng.random() < 0.3))
        want = []
        for i, (_, indent, _) in enumerate(lines):
            stop = next((k for k in range(i + 1, len(lines)) if lines[k][1] <= indent), None)
            want.append(lines[-1][0] if stop is None else lines[stop][0] if lines[stop][2] else lines[stop - 1][0])
        assert body_ends(lines) == want


def test_nesting_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        indents = [rng.randrange(5) for _ in range(rng.randrange(1, 20))]
        want = []
        for i, own in enumerate(indents):
            chain, least = 0, own
            for k in range(i - 1, -1, -1):
                if indents[k] < least:
                    chain, least = chain + 1, indents[k]
            want.append(chain)
        assert nesting(indents) == want


def test_tables():
    source = "class Tree:\n    rings = 3\n\n    def grow(self):\n        self.rings += 1\n\n        def sprout():\n            return 1\n\n\ndef fell(tree):\n    return tree\n"
    assert found(source) == [("class", "Tree", 1, 3, 0), ("def", "grow", 4, 6, 1), ("def", "sprout", 7, 8, 2), ("def", "fell", 11, 12, 0)]
    assert found("module Grove\n  def plant\n  end\nend\n") == [("module", "Grove", 1, 1, 0), ("def", "plant", 2, 3, 1)]
    assert found("fn a() { 1 }\nfn b() { 2 }") == [("fn", "a", 1, 1, 0), ("fn", "b", 2, 2, 0)]
    assert found("def late():\n" + " " * 8 + "\n\n") == [("def", "late", 1, 1, 0)]
    assert found("#" * ((8 << 20) + 1) + "\ndef late():\n") == [] and found("") == []


@pytest.mark.parametrize("at", range(len(codebase.LANGUAGES)))
def test_stated_blocks(at):
    """The blocks of the code corpus: declarations, comments, and code without literals are as stated beside the text."""
    for block in codebase.LANGUAGES[at][1]:
        source = "\n".join(block.text).replace("@", "7") + "\n"
        table, code, notes = analyze(source)
        assert [(d.start_line, d.end_line, d.name, d.kind, d.depth) for d in table] == [(a, z, n.replace("@", "7"), k, d) for a, z, n, k, d in block.decls]
        assert [(i, x.rstrip()) for i, x in enumerate(notes, 1) if x.strip()] == [(i, x.replace("@", "7")) for i, x in block.notes]
        for i, x in block.codes:
            assert code[i - 1].rstrip() == x.replace("@", "7")


def test_hash_signs():
    """Attributes, directives and colours are code; all else after a hash is a comment."""
    for code in ("#![no_mangle]", "#[test]", "#ifdef ORCHARD", "#pragma once", "c = #a1b2c3", "c = #FFF;", "c = #11223344"):
        assert Masker().render(code) == (code, " " * len(code))
    for comment in ("#pear", "# if ripe", "#!pear", "#", "#12345", "#ggg", "#pragmatic"):
        assert Masker().render(comment) == (" " * len(comment), comment)


def test_what_goes_on_in_the_next_line():
    states = [("a = '''b", "b # c", "d''' # e"), ("a /* # b", "// c", "*/ d"), ('a = "b\\', 'c" + d'), ('a = "b', "c")]
    shown = [[m.render(x) for x in lines] for lines in states for m in [Masker()]]
    assert [[x.rstrip() for x, _ in s] for s in shown] == [["a =", "", ""], ["a", "", "   d"], ["a =", "   + d"], ["a =", "c"]]
    assert [[x.strip() for _, x in s] for s in shown] == [["", "", "# e"], ["/* # b", "// c", "*/"], ["", ""], ["", ""]]


def test_masks_keep_bytes():
    rng = random.Random(5)
    for _ in range(400):
        source = "".join(rng.choices(["'", '"', "'''", "/*", "*/", "//", "#", "\\", "\n", "\r\n", "é", "木", " ", "x", "[", "ff"], k=30))
        lines = source.encode().decode("latin-1").split("\n")
        lines = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]
        _, code, notes = analyze(source)
        assert [len(x) for x in code] == [len(x) for x in notes] == [len(x) for x in lines]
        for line, c, n in zip(lines, code, notes, strict=True):
            assert all(b == a or b == " " for a, b in zip(line, c, strict=True)) and all(b == a or b == " " for a, b in zip(line, n, strict=True))
            assert not any(b != " " and d != " " for b, d in zip(c, n, strict=True)) and re.fullmatch(r"[^\n]*", c)
