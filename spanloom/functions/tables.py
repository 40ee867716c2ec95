"""Word lists and file tables.

Fixed values: results depend on these words, names and endings, so they are stated as they have to be.
"""

KEYWORDS = frozenset("class const def enum fn func function impl interface macro mod module namespace record static struct trait type var".split())
MODIFIERS = frozenset("abstract async const declare default export extern final inline internal local open override partial private protected pub public readonly sealed static unsafe virtual".split())
CONTROL_WORDS = frozenset(
    "and assert await case catch defer delete do elif else except finally for go if in is lock match new not or raise return select sizeof switch throw try typeof unless until using when while with yield".split()
)
PREPROCESSOR_DIRECTIVES = ("define", "elif", "else", "endif", "error", "if", "ifdef", "ifndef", "include", "line", "pragma", "undef", "warning")
CALLABLE_WORDS = frozenset("function func fn lambda async def".split())

LANGUAGES = {
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"],
    "cs": ["cs"],
    "css": ["css", "sass", "scss"],
    "elixir": ["ex", "exs"],
    "go": ["go"],
    "haskell": ["hs"],
    "html": ["htm", "html"],
    "java": ["java"],
    "js": ["cjs", "js", "jsx", "mjs"],
    "json": ["json"],
    "kotlin": ["kt", "kts"],
    "lua": ["lua"],
    "md": ["markdown", "md"],
    "php": ["php"],
    "py": ["py", "pyi"],
    "python": ["py", "pyi"],
    "r": ["r"],
    "rb": ["rb"],
    "rs": ["rs"],
    "ruby": ["rb"],
    "rust": ["rs"],
    "scala": ["sc", "scala"],
    "sh": ["bash", "sh", "zsh"],
    "sql": ["sql"],
    "swift": ["swift"],
    "toml": ["toml"],
    "ts": ["cts", "mts", "ts", "tsx"],
    "typescript": ["cts", "mts", "ts", "tsx"],
    "yaml": ["yaml", "yml"],
    "zig": ["zig"],
}

TEST_DIRS = ["__tests__", "spec", "specs", "test", "testing", "tests"]
TEST_ENDINGS = ["-spec", "-specs", "-test", "-tests", ".spec", ".specs", ".test", ".tests", "_spec", "_specs", "_test", "_tests"]
TEST_STARTS = ["spec_", "test_"]
TEST_CAMEL = ["Spec", "Test", "Tests"]
TEST_STEMS = ["spec", "test"]

#: Limits and weights.
MAX_FILE_BYTES = 8 << 20
MATCH_CAP, HINT_LINES = 512, 16
CHUNK, BATCH, OVERSAMPLE, TOKENS_PER_LINE = 256, 8, 4, 12
#: Candidates whose paths the driver may gather; with more, all are ranked and read where they are.
WIDE = 16384
#: Rows of a given list that may be broadcast.
FEW = 100_000
#: Bytes of a content that may travel with its rank.
CARRIED = 1 << 16
ORPHAN_CONTEXT, MAX_TOKENS, MAX_PER_FILE = 6, 2000, 3
WEIGHTS = {"matches": 1.0, "terms": 1.5, "path": 1.0, "depth": 1.0}
#: The published split of a text into pieces, without its look-ahead.
TOKEN_PIECES = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|"
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|"
    r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+"
)
TOKEN_PIECES_EXACT = TOKEN_PIECES[: -len(r"|\s+")] + r"|\s+(?!\S)|\s+"
