"""Every operator on awkward rows, against brute force where SQL can't say what is right."""

import base64
import bz2
import gzip
import hashlib
import lzma
import math
import random
import re
import time
import unicodedata
import zlib
from urllib.parse import quote

import numpy as np
import pytest
import zstandard

from spanloom.llm import jaccard, langid, linear, media, mixing, packing, quality, queries, secret_scan, sharding, simhash, topk, warc

LONG = "word " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, key int, shard string, fp string, label string, skey int, row string"
ROWS = [
    (1, "the quick brown fox jumps", "en", "a"),
    (1, "the quick brown fox jumps", "en", "a"),
    (2, "the quick brown fox jumps", "en", None),
    (3, None, None, None),
    (4, "", "fr", "b"),
    (5, LONG, "de", "b"),
    (None, "no id here", None, "c"),
    (6, "1234 !!", "en", "c"),
    (7, "\x1c odd <|endoftext|> \x85 ΑΣ É é", None, "d"),
    (None, None, None, None),
]


def table(spark, rows=ROWS):
    data = [(a, b, c, d, len(b) if b else None, "i", "s", 1, "x", "f", "l", 2, "r") for a, b, c, d in rows]
    return spark.createDataFrame(data, SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_secrets_base_and_layers(spark):
    inner = "password = hunter2hunter2hunter2"
    packed = base64.b64encode(gzip.compress(f"x {inner} y".encode())).decode()
    texts = {
        1: f"see {base64.b64encode(inner.encode()).decode()} end",
        2: f"q={quote(quote(inner, safe=''), safe='')}",
        3: "".join(f"\\u{ord(c):04x}" for c in inner),
        4: f"blob {packed}",
        5: f"twice {base64.b64encode(packed.encode()).decode()}",
        6: "token: secret: abcdefghijklmnop AKIAABCDEFGHIJKLMN 0123456789abcdef",
        7: "dG9rZW4 " * 20_000,
    }
    got = {r["doc_id"]: r for r in rows_of(secret_scan.scan_secrets(table(spark, [(k, v, None, None) for k, v in texts.items()])))}
    for k in (1, 2, 3, 4, 5):
        assert got[k]["n_assign"] == 0 and got[k]["base_sha256"] == hashlib.sha256(b"").hexdigest()
        spans = [tuple(x.split(":")) for x in got[k]["spans"].split(",")]
        assert all(kind == "assign" and 0 <= int(s) < int(e) <= len(texts[k]) for kind, s, e in spans) and spans
    assert got[3]["spans"] == f"assign:0:{len(texts[3])}"
    assert got[1]["spans"].startswith("assign:4:")
    assert got[6]["spans"] == "access:32:50,hex:51:67" and got[6]["n_assign"] == 0
    assert secret_scan.redacted(texts[6]) == "token: secret: abcdefghijklmnop [access secret] [hex secret]"


def test_cycle_and_bomb():
    bomb = base64.b64encode(zlib.compress(b"\0" * (80 << 20))).decode()
    assert secret_scan.find_secrets(bomb) == ([], [])
    assert secret_scan.find_secrets("%25" * 1000)[1] == []


def test_secrets_nested_deep():
    """Escapes that escape their own signs: in one pass below a depth, as layer by layer, and soon done."""
    began = time.perf_counter()
    for text in ("%" + "25" * 500_000, "\\" + "u005c" * 100_000 + "u0041", "&" + "#38;" * 100_000 + "#65;", "%5C" + "u00255C" * 50_000):
        secret_scan.find_secrets(text)
    assert time.perf_counter() - began < 60
    for depth in (1, 7, 8, 9, 25):
        text = "password = hunter2hunter2"
        for _ in range(depth):
            text = quote(text, safe="")
        text = "~ " + text + " ~"
        assert (2, 0, len(text) - 2) in secret_scan.find_secrets(text)[1]

    def layered(t):
        for _ in range(60):
            layers = (next(f(secret_scan.Layer(t)), None) for f in (secret_scan._percent, secret_scan._escapes))
            new = next((x.text for x in layers if x and x.text != t), None)
            if new is None:
                return t
            t = new

    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices(["%", "25", "41", "5C", "u00", "x", "2", "5", "é", "\\", "a", "z ", " ", "%C3%A9", "%E9", "&#", "38;"], k=12))
        one = next(secret_scan._unescaped(secret_scan.Layer(text)), None)
        assert (one.text if one else text) == layered(text), text


SECRET = b"password = hunter2hunter2"


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_secrets_of_all_members(pack):
    spans = lambda data: secret_scan.find_secrets(base64.b64encode(data).decode())[1]
    n = lambda data: len(base64.b64encode(data))
    for data in (pack(b"a") + pack(SECRET), pack(pack(b"a") + pack(b"b") + pack(SECRET)), pack(b"a b ") + SECRET, pack(b"x " + SECRET)):
        assert spans(data) == [(0, 0, n(data))], pack


def test_secrets_far_into_a_layer():
    data = base64.b64encode(gzip.compress("é ".encode() * (23 << 20) + b" " + SECRET, 1)).decode()
    assert secret_scan.find_secrets(data)[1] == [(0, 0, len(data))]


def test_secrets_of_every_piece():
    find = lambda text: secret_scan.find_secrets(text)[1]
    assert find("GET /dXNlcj1hbGljZXdvbmRlcg/c2VjcmV0PWFiY2RlZmdoaWprbG1ub3A HTTP") == [(28, 0, 59)]
    for inner in (b"?>?>?> " + SECRET, b"~~~ " + SECRET + b" ?>?>", gzip.compress(SECRET * 3)):
        for code in (base64.b64encode, base64.urlsafe_b64encode):
            for prefix in ("v/", "a-b/", "path/to_some/"):
                text = prefix + code(inner).decode()
                assert any(kind == 0 and start >= len(prefix) for start, kind, _ in find(text)), text


@pytest.mark.parametrize("data", [b"caf\xe9 " + SECRET, SECRET + b" \x00\x01\x02\x03\xff\xfe\x80\x81" * 9, SECRET.decode().encode("utf-16-le"), SECRET.decode().encode("utf-16-be"), b"\xff\xfe" + SECRET + b"!"])
def test_secrets_beside_odd_bytes(data):
    for text in (base64.b64encode(data).decode(), base64.b64encode(gzip.compress(data)).decode(), "v/ab_c/d/" + base64.b64encode(data).decode(), "".join(f"%{b:02X}" for b in data)):
        spans = secret_scan.find_secrets(text)[1]
        assert any(kind == 0 and 0 <= start < end <= len(text) for start, kind, end in spans), text
    assert secret_scan.find_secrets("%E9%70assword = hunter2hunter2")[1] == [(3, 0, 30)]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
@pytest.mark.parametrize("join", ["\n", "\r\n", "\n    ", "\r\t"])
@pytest.mark.parametrize("before", ["", "-----BEGIN DATA-----\n", "see below\n", "Key: "])
def test_secrets_over_lines(pack, join, before):
    """A secret across a line end, and a payload that only inflates whole."""
    code = base64.b64encode(pack(bytes(random.Random(5).choices(range(97, 123), k=45)) + b" " + SECRET + b" " + bytes(random.Random(6).choices(range(97, 123), k=150)))).decode()
    text = before + join.join(code[i : i + 64] for i in range(0, len(code), 64)) + "\n-----END"
    assert any(kind == 0 and len(before) <= start < len(before) + 70 < end for start, kind, end in secret_scan.find_secrets(text)[1])


def test_media_round_trip(spark):
    got = rows_of(media.read_back(media.store_texts(table(spark))))
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]) or ""
        payload = text.encode() + b"\xff" * (-len(text.encode()) % 576 if text else 576)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_media_in_one_stage(spark, tmp_path):
    """The query's media are read where they were made: one Python stage, with the rows of the two operators."""
    docs = table(spark)
    got = media.round_trip(docs)
    assert sorted(map(str, rows_of(got))) == sorted(map(str, rows_of(media.read_back(media.store_texts(docs)))))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op3_media_columns(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("kind", media.KINDS)
def test_sniffing(kind):
    whole = media.encode(bytes(range(256)) * 9, kind)
    assert media.decode(whole, kind) == bytes(range(256)) * 9
    assert (media.sniff(whole, "image/gif").actual, media.sniff(whole, kind).corrected) == (kind, False)
    assert media.sniff(b"junk" + whole + b"more").carved == [(4, len(whole), kind)]
    assert media.sniff(whole[:-1]).actual == media.UNKNOWN
    assert media.sniff(None).actual == media.UNKNOWN and media.sniff(b"").carved == []


def test_sniffing_others():
    for data, kind in ((gzip.compress(b"x" * 99), "application/gzip"), (b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;", "image/gif"), (b"%PDF-1.4\nstartxref\n0\n%%EOF", "application/pdf")):
        assert media.sniff(data + b"tail").actual == kind and media.sniff(data + b"tail").length == len(data)


def test_sniffing_is_linear():
    """Blobs full of magic bytes whose validators look far ahead."""
    began = time.perf_counter()
    wave = b"data\x0c\0\0\0RIFF\xff\xff\xff\x7fWAVE"
    for unit in (b"PK\x03\x04", b"%PDF-", b"%PDF-startxref", b"GIF89a\1\0\1\0\0\0\0!\xf9\1\0\0", b"\xff\xd8\xff\xc0\0\2\xff\xda\0\2", wave):
        assert media.sniff(unit * (400_000 // len(unit))).carved == []
    assert time.perf_counter() - began < 20


def test_sniffing_against_simple_walks():
    """Chains that meet, as each validator alone would see them."""
    rng = random.Random(8)
    for _ in range(300):
        chunks = b"".join(rng.choice([b"fmt ", b"data", b"LIST"]) + n.to_bytes(4, "little") + bytes(n + n % 2) for n in rng.choices(range(6), k=rng.randrange(1, 6)))
        one = lambda extra=0: b"RIFF" + (4 + len(chunks) + extra).to_bytes(4, "little") + b"WAVE" + chunks  # noqa: B023, E731
        data = b"".join(rng.choice([one(), one(rng.choice((2, 8))), b"junk", b"RIFF\0\0\0\0WAVE"]) for _ in range(4))
        want = []
        for m in re.finditer(b"RIFF", data):
            at = m.start()
            end, i = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 12
            while i + 8 <= min(end, len(data)):
                i += 8 + (int.from_bytes(data[i + 4 : i + 8], "little") + 1) // 2 * 2
            if data[at + 8 : at + 12] == b"WAVE" and i == end <= len(data) and end >= at + 20:
                want.append((at, end - at))
        got = media.sniff(data)
        assert ([(0, got.length)] if got.length else []) + [(a, n) for a, n, _ in got.carved] == want


def test_carving(spark):
    inner = [media.encode(bytes(range(256)) * 9, k) for k in media.KINDS]
    whole = b"head" + inner[0] + b"gap" + inner[1] + inner[2] + gzip.compress(b"x")
    df = spark.createDataFrame([(1, whole), (2, None), (3, b""), (4, inner[0])], "id long, media binary")
    got = sorted((r["id"], r["offset"], r["type"], bytes(r["media"])) for r in rows_of(media.carve(df, "id")))
    assert [x[2:] for x in got] == [*zip(media.KINDS, inner, strict=True), ("application/gzip", gzip.compress(b"x"))] or [x[3] for x in got][:3] == inner
    assert all(whole[a : a + len(m)] == m for _, a, _, m in got) and {x[0] for x in got} == {1}
    assert all(hashlib.sha256(bytes(r["media"])).hexdigest() == r["sha256"] and len(r["media"]) == r["length"] for r in rows_of(media.carve(df, "id")))


def test_warc(spark):
    body = "<p>" + "x" * 200
    pages = [(3, "http://a b/\r\nX", body), (1, None, body), (1, "u", body), (7, "u", body), (5, "u", "small"), (6, "u", "small"), (8, "u", None), (None, "u", body), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 99), (10, "u", LONG)]
    df = spark.createDataFrame([(*p, "a", 1) for p in pages], "page_id long, url string, html string, digest string, low int")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows_of(warc.round_trip(df)))
    want = sorted((p or 0, len((h or "").encode()), "revisit" if h == body and p and p > 1 else "response", 1 if h == body and p and p > 1 else None) for p, _, h in pages)
    assert got == want
    index = warc.sidecar(warc.normalize(warc.write_archives(warc.with_revisits(df)))).collect()
    assert len(index) == len(pages)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    """Archives as files, read by other means too; monolithic ones from elsewhere; a revisit whose response is gone."""
    pages = [(i, f"http://x/{i}", f"<p>page {i % 7}</p>" * 20) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    normal = warc.materialize(warc.normalize(warc.write_archives(warc.with_revisits(df).repartition(3))), "test")
    told = rows_of(warc.export_archives(normal, str(tmp_path)))
    assert sum(r["records"] for r in told) == 40
    index = rows_of(warc.read_sidecars(spark, str(tmp_path)))
    assert len(index) == 40
    for r in index:
        raw = (tmp_path / f"{r['archive_id']}.warc.gz").read_bytes()
        assert gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]]).startswith(b"WARC/1.1\r\nWARC-Type: " + r["type"].encode())
    whole = b"".join(gzip.decompress((tmp_path / f"{r['archive_id']}.warc.gz").read_bytes()) for r in told)
    (tmp_path / "other").mkdir()
    (tmp_path / "other/one.warc.gz").write_bytes(gzip.compress(whole))
    for folder in (tmp_path, tmp_path / "other"):
        again = warc.normalize(warc.import_archives(spark, str(folder)))
        got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in rows_of(warc.read_pages(again)))
        assert got == [(i, len(h), hashlib.sha256(h.encode()).hexdigest(), i % 7 if i >= 7 else None) for i, _, h in pages]
    with pytest.raises(Exception, match="no such response: 3"):
        lone = warc.with_revisits(df).filter("page_id <> 3")
        warc.read_pages(warc.normalize(warc.write_archives(lone))).collect()


def test_simhash(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 100
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([2, 30, 200]))]
        for _ in range(5):
            copy = list(text)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n := n + 1, " ".join(copy), None, None))
    rows += ROWS
    got = rows_of(simhash.near_duplicates(table(spark, rows)))
    assert len(got) == len(rows)
    prints = {simhash.fingerprint(t) for _, t, *_ in rows}
    comp = {p: {p} for p in prints}
    for p in prints:
        for q in prints:
            if (p ^ q).bit_count() <= 3 and comp[p] is not comp[q]:
                comp[p] |= comp[q]
                for x in comp[q]:
                    comp[x] = comp[p]
    low = {p: min((i for i, t, *_ in rows if i is not None and simhash.fingerprint(t) in comp[p]), default=None) for p in prints}
    for r in got:
        assert r["component_id"] == low[int(r["fingerprint"], 16)]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_trie_and_dealing(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    near = centre ^ np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(150)], np.uint64)
    prints = np.unique(np.r_[near, rng.integers(0, 2**63, 200, dtype=np.uint64)])
    want = {(i, k) for i in range(len(prints)) for k in range(i + 1, len(prints)) if int(prints[i] ^ prints[k]).bit_count() <= 3}
    assert set(simhash.trie_links(prints, 3)) == want
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in rows_of(simhash.components(simhash.links(df, bucket=8)))}
    ids = prints.view(np.int64).tolist()
    for i, k in want:
        assert roots.get(ids[i], ids[i]) == roots.get(ids[k], ids[k])


def test_text_xxhash_is_spark_s(spark):
    assert simhash.fingerprint("A b\tc") == spark.sql("select xxhash64('a b c')").first()[0] % 2**64


def test_topk(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[100:160] = m[100]
    data = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(m)]
    data += [(1000, None, "x", 1), (1050, [1.0, None], "x", 1), (1100, [float("nan")] * 8, "x", 1), (1150, [float("inf")] * 8, "x", 1), (None, [1.0] * 8, "x", 1), (1200, [1.0, 2.0], "x", 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, cell string, rank int")
    from pyspark.sql import functions as F

    q = F.pmod(F.col("vec_id"), F.lit(50)) == 0
    q8 = np.floor(256 * np.vstack([m, np.r_[1, 2, np.zeros(6)]]).astype(np.float64))
    ids = [*range(300), 1200]
    want = topk.brute_force(ids, q8, [i for i, x in enumerate(ids) if x % 50 == 0])
    got = topk.top_k(df, q).toPandas().sort_values(["query_id", "rank"])
    assert got.values.tolist() == want.values.tolist()
    assert topk.top_k(df.limit(0), q).count() == 0
    assert topk.top_k(df.filter("vec_id in (50, 51, 52)"), q).count() == 2


def test_topk_skewed(spark, monkeypatch):
    """Small blocks, many salts, one vector for most rows."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SAMPLE", 20)
    data = [(i, [1.0, 2.0] if i % 3 else [float(i % 7), 1.0]) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.pmod(F.col("vec_id"), F.lit(50)) == 0).toPandas().sort_values(["query_id", "rank"])
    v = np.array([[256 * x for x in d[1]] for d in data])
    assert got.values.tolist() == topk.brute_force(list(range(200)), v, [0, 50, 100, 150]).values.tolist()


def test_mixing(spark):
    got = rows_of(mixing.mix(table(spark)))
    assert len(got) == len(ROWS)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
    taken, size = sum(r["taken"] for r in got), sum(r["size"] for r in got)
    assert abs(taken - size) <= 5
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(table(spark).repartition(3)))))
    assert mixing.mix(table(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + ("!!" if i % 3 == 0 else "") for _ in range(60)), "en", f"s{i % 3}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    df = table(spark, docs + ROWS)
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r for r in rows_of(quality.score_quality(df, model)) if r["doc_id"] and r["doc_id"] >= 200}
    assert np.mean([got[i]["quality"] == int(i % 3 > 0) for i in range(200, 300)]) > 0.95
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and not kept.filter("text is null or text = ''").count()
    none = quality.fit(df, labels.limit(0))
    assert none.text is None and quality.keep_good(table(spark), none).count() == 6
    assert quality.score_quality(table(spark, []), model).count() == 0


def test_quality_of_a_repeated_id(spark):
    """An id that most rows share is learned from once; all its rows are scored, and the fit agrees over partitions and with one by hand."""
    docs = [(i, f"some words {i}" + " !!" * (i % 2), "en", "s") for i in range(40)] + [(5, f"other words {i}", "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    models = [quality.fit(table(spark, docs).repartition(n), labels) for n in (1, 5)]
    views = {}
    for i, text, lang, source in docs:
        x, z = quality._views([(text, lang, source, len(text))])
        views[i] = min(views.get(i, b"\xff" * 9999), np.hstack([x, z]).astype(np.float16).tobytes())
    f = np.array([np.frombuffer(views[i], np.float16) for i in range(40)], np.float32)
    hand = quality.co_train(np.ascontiguousarray(f[:, : -quality.META]), np.ascontiguousarray(f[:, -quality.META :]), np.array([i % 2 if i < 30 else -1.0 for i in range(40)]))
    for m in models:
        assert np.array_equal(m.text, models[0].text) and np.allclose(m.text, hand.text, atol=1e-5) and np.allclose(m.page, hand.page, atol=1e-5) and m.prior == hand.prior
    assert quality.score_quality(table(spark, docs), models[0]).count() == len(docs)


def test_quality_without_letters():
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["spam", "junk"]) if i % 2 else f"{rng.randrange(1000)}.5" for _ in range(40)), "en", "a", None) for i in range(200)]
    x, z = quality._views(rows)
    model = quality.co_train(x, z, (np.arange(200) % 2 == 0).astype(float))
    scores = quality.score_rows(model, [*rows[:2], ("", "en", "a", 0), (None, "en", "a", None)])[:, 2]
    assert scores[0] >= quality.THRESHOLD > scores[1] and not scores[2:].any()


def test_language(spark):
    rng = random.Random(4)
    words = {"en": "the and with of this", "de": "der und mit von dies", "fr": "le et avec du ce", "es": "el y con del esto", "xx": "zzo qqi kka"}
    docs = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(40)), lang, None) for i, lang in enumerate(list(words) * 60)]
    df = table(spark, docs + ROWS)
    got = rows_of(langid.identify(df, langid.fit(df)))
    assert len(got) == len(docs) + len(ROWS)
    truth = {i: lang for i, _, lang, _ in docs if i > 10}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 6)} - set(words) == {"und"} - set(words)
    blank = langid.identify(table(spark), langid.fit(table(spark, [])))
    assert {r["lang_pred"] for r in rows_of(blank)} == {"und"}


def test_tokenizer_is_the_library_s():
    t = packing.WordTokenizer(queries.vocabulary())
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghiXYZ'!?éßñ.01 ​\t\n世界ÀÖ_-́\x1c\x85ΣςσİıŁ😀", k=rng.randint(0, 60))) for _ in range(3000)] + [x[1] or "" for x in ROWS]
    for x in texts:
        assert t.ids(x).tolist() == t.full.encode(x, add_special_tokens=False).ids, repr(x)


def test_tokenizer_over_all_planes():
    """Marks that compose or change places among them; tables of either side differ by version."""
    t = packing.WordTokenizer(queries.vocabulary())
    rng = random.Random(7)
    marks = [chr(i) for i in range(0x110000) if unicodedata.combining(chr(i))]
    planes = (0x250, 0x3000, 0x10000, 0x110000)
    one = lambda: chr(k) if not 0xD800 <= (k := rng.randrange(rng.choice(planes))) < 0xE000 else "x"
    cases = ["\ufe24\u1abf", "\ua67d\ua82c", "\u09fe\u0fc6", "\u089b\u0e39", "i\u0307 İ", "Σ ΑΣ", "\u212b e\u0301"]
    cases += ["".join(rng.choice((one(), rng.choice(marks), rng.choice("abXYİßé .!\n0"))) for _ in range(rng.randrange(12))) for _ in range(30_000)]
    for x in cases:
        assert t.ids(x).tolist() == t.full.encode(x, add_special_tokens=False).ids, ascii(x)


def test_packing(spark):
    rows = ROWS + [(100 + i, "some words to pack " * (i % 37), None, f"s{i % 4}") for i in range(200)]
    got = rows_of(packing.pack(table(spark, rows), queries.vocabulary()))
    full = packing.WordTokenizer(queries.vocabulary()).full
    want = sorted((i or -1, len(full.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows)
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in got if r["start"] == 0) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    for r in got:
        if r["doc_id"] == 5:
            ids = np.array([*full.encode(LONG, add_special_tokens=False).ids, 1], "<u4")[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
    assert packing.pack(table(spark, []), queries.vocabulary()).count() == 0


def test_packing_mixture(spark):
    """A window holds the sources' shares, but for the document at each edge."""
    rows = [(i, "a b c d e f g h i " * 20, None, "big" if i % 4 else "small") for i in range(6000)]
    tokens = packing.materialize(packing.tokenize(table(spark, rows), queries.vocabulary(), "doc_id", "text", "source"), "t")
    where, total = packing.places(tokens)
    at = where.join(tokens.select("row", "skey", "n"), "row").toPandas().sort_values("place")
    assert (at["place"].to_numpy() == np.r_[0, at.n.cumsum()[:-1]]).all() and at.n.sum() == total
    for _, window in list(at.groupby(at["place"] // packing.WINDOW))[:-1]:
        share = window.n[window.skey == "ssmall"].sum() / window.n.sum()
        assert abs(share - 0.25) < 0.01


def test_packing_weights(spark):
    """Weights set the shares of a window while both queues last; a source without one keeps its own share."""
    rows = [(i, "a b c d e f g h i " * 20, None, f"s{i % 3}") for i in range(6000)]
    tokens = packing.materialize(packing.tokenize(table(spark, rows), queries.vocabulary(), "doc_id", "text", "source"), "t")
    for weights, want in (({"s0": 3, "s1": 1}, (0.5625, 0.1875, 0.25)), ({"s0": 1, "s1": 1, "s2": 2}, (0.25, 0.25, 0.5)), ({}, (1 / 3,) * 3)):
        where, total = packing.places(tokens, weights)
        at = where.join(tokens.select("row", "skey", "n"), "row").toPandas().sort_values("place")
        assert (at["place"].to_numpy() == np.r_[0, at.n.cumsum()[:-1]]).all() and at.n.sum() == total
        first = at[at["place"] < packing.WINDOW]
        for k, share in enumerate(want):
            assert abs(first.n[first.skey == f"ss{k}"].sum() / first.n.sum() - share) < 0.02, (weights, k)


def test_sharding(spark):
    rows = ROWS + [(1000 + i, "x" * (i * 7 % 500), None, None) for i in range(3000)]
    got = rows_of(sharding.shard(table(spark, rows)))
    assert len(got) == len(rows)
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert len(got) == 3010 and all(r["text_crc32"] == zlib.crc32((next(t for i, t, *_ in rows if i == r["doc_id"]) or "").encode()) for r in got if r["doc_id"])
    assert sharding.shard(table(spark, [])).count() == 0
    # Without the one record that outweighs a shard, sizes are near equal.
    even = rows_of(sharding.shard(table(spark, [r for r in rows if r[0] != 5])))
    load = [sum(r["size"] for r in even if r["shard"] == s) for s in range(8)]
    assert max(load) - min(load) <= 64, load
    rng = random.Random(1)
    sizes = [rng.randrange(1000, 2000) for _ in range(sharding.SLOTS)]
    plan = sharding.first_map().rebalanced(sizes)
    totals = [sum(x for x, s in zip(sizes, plan.current, strict=True) if s == k) for k in range(8)]
    assert max(totals) - min(totals) <= 1000
    grown = plan.grown(sizes, 8)
    assert all(b in (a, 8) for a, b in zip(plan.current, grown.current, strict=True)) and abs(sum(x for x, s in zip(sizes, grown.current, strict=True) if s == 8) - sum(sizes) / 9) < 3000


def test_sharding_hot_rows(spark):
    """A third of all rows are one: they fill every shard alike, and places have no gaps."""
    rows = [(1, "the same text " * 5, None, None)] * 9000 + [(i, f"text {i}", None, None) for i in range(2, 18000)]
    got = rows_of(sharding.shard(table(spark, rows).repartition(7)))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    hot = [sum(r["doc_id"] == 1 for r in got if r["shard"] == s) for s in range(8)]
    assert len(got) == len(rows) and max(load) - min(load) <= 200 and max(hot) <= 2 * min(hot)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_sharding_goes_on_from_its_map(spark, tmp_path):
    """A stored map is read back and edited: on grown data only the slots that its new version moves change their shard."""
    path = str(tmp_path / "map")
    rows = [(i, "x" * (i * 7 % 500), None, None) for i in range(12000)]
    first = {r["doc_id"]: r for r in rows_of(sharding.shard(table(spark, rows[:6000]), map_path=path))}
    again = {r["doc_id"]: r for r in rows_of(sharding.shard(table(spark, rows[:6000]), map_path=path))}
    assert first == again and len(sharding.stored_map(spark, path).versions) == 2
    later = {r["doc_id"]: r for r in rows_of(sharding.shard(table(spark, rows), map_path=path))}
    plan = sharding.stored_map(spark, path)
    assert len(plan.versions) == 3 and {r["map_version"] for r in later.values()} == {3}
    moved = {s for s, (a, b) in enumerate(zip(*plan.versions[1:], strict=True)) if a != b}
    assert 0 < len(moved) < sharding.SLOTS // 8
    assert {r["virtual_slot"] for i, r in later.items() if i in first and r["shard"] != first[i]["shard"]} <= moved
    load = [sum(r["size"] for r in later.values() if r["shard"] == s) for s in range(8)]
    assert max(load) - min(load) <= 600


def test_mixing_and_packing_hot_rows(spark):
    """A third of all rows are one."""
    rows = [(1, "one two three", None, "hot")] * 3000 + [(i, f"word {i} " * (i % 9), None, f"s{i % 5}") for i in range(2, 6000)]
    mixed = rows_of(mixing.mix(table(spark, rows).repartition(5)))
    for r in {r["source_size"]: r for r in mixed}.values():
        own = [x for x in mixed if x["source_size"] == r["source_size"] and x["target"] == r["target"]]
        assert abs(sum(x["taken"] for x in own) - r["target"]) <= 1 and all(x["taken"] <= 3 * x["size"] for x in own)
    packed = rows_of(packing.pack(table(spark, rows).repartition(5), queries.vocabulary()))
    assert sum(r["start"] == 0 for r in packed) == len(rows) and sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = table(spark, ROWS + [(50 + i, f"The token = 0123456789abcdef{i:04x} and plain words number {i} " * 3, "en", f"s{i % 3}") for i in range(40)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    at = docs
    for name, stage in p.STAGES[:-1]:
        at = p.materialize(stage(spark, at, d), "test")
        assert at.columns == docs.columns and at.count(), name
        if name == "SimHash near-dedup":
            prints = [simhash.fingerprint(r.text) for r in at.collect()]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
        if name == "secret scans":
            assert all(not secret_scan.find_secrets(r.text)[1] and r.n_chars == len(r.text) for r in at.collect())
    assert p.run(spark, d).count() > 0


def test_contract_regexes():
    """The scanner's shortcuts against the contract's own patterns."""
    rng = random.Random(9)
    plain = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")
    bits = ["token", "SECRET", "api_key", "paſſword", "=", ":", " ", '"', "AKIA", "AKIAB", "abc0123456789", "XYZ012", "f", "é", "\n"]
    for _ in range(2000):
        text = "".join(rng.choices(bits, k=12))
        want = []
        for k, p in enumerate(plain):
            for m in re.finditer(p, text):
                if len(m[2] if k == 0 else m[0]) >= (12, 18, 16)[k]:
                    want.append((m.start(), k, m.end()))
        assert secret_scan.scan(text) == sorted(want)


def test_pipeline_near_copies(spark):
    """Against brute force: all pairs of similarity 0.8 or more, in buckets of any size; a hot group and a common passage among them."""
    import corpus_pipeline as p

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base, texts = text(40), text(200), []
    for _ in range(25):
        one = text(rng.randrange(30, 250))
        texts += [one, list(one), *([rng.choice(words) if rng.random() < rate else w for w in one] for rate in (0.005, 0.01, 0.02, 0.03, 0.04))]
    texts += [[rng.choice(words) if rng.random() < 0.01 else w for w in base] for _ in range(60)] + [text(60) + passage + text(60) for _ in range(40)]
    texts = [" ".join(t) for t in texts] + ["", None, " ", "two words", "Two  words", "two"]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for k in range(i):
            if 5 * len(a & sets[k]) >= 4 * len(a | sets[k]) and root[i] != root[k]:
                root = [min(root[i], root[k]) if r in (root[i], root[k]) else r for r in root]
    want = {i for i, r in enumerate(root) if i == r}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in rows_of(p.drop_near_copies(spark, df, ""))} == want
    assert {r["doc_id"] for r in rows_of(jaccard.later_copies(df, "doc_id", block=7))} == set(range(len(texts))) - want


def test_wide_prints_of_similar_sets():
    """Of sets that are just similar, far fewer bits differ than rule a pair out, whatever their sizes."""
    rng = np.random.default_rng(1)
    distance = lambda a, b: int(np.bitwise_count((jaccard.wide_print(a) ^ jaccard.wide_print(b)).view(np.uint64)).sum())
    for n in (5, 9, 10, 40, 300):
        far = []
        for _ in range(200):
            a = rng.integers(-(2**63), 2**63, n)
            for b in (a[: -(-4 * n // 5)], np.r_[a[: -(-8 * n // 9)], rng.integers(-(2**63), 2**63, n - -(-8 * n // 9))]):
                x, y = np.unique(a), np.unique(b)
                assert jaccard.similar(x, y)
                far.append(distance(x, y))
        assert max(far) <= 80 < jaccard.BUDGET
    one = [np.unique(rng.integers(-(2**63), 2**63, 50)) for _ in range(60)]
    assert np.mean([distance(a, b) > jaccard.BUDGET for i, a in enumerate(one) for b in one[:i]]) > 0.99


def test_links_of_a_bucket():
    """The bucket's own check against all pairs: groups that are joined, across blocks and within one."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 60)
    sets = []
    for _ in range(70):
        s = base.copy()
        s[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(-(2**62), 2**62)
        sets.append(np.unique(np.r_[s, rng.integers(-(2**62), 2**62, rng.integers(0, 4))]))
    n, wide = np.array([len(s) for s in sets]), np.array([jaccard.wide_print(s) for s in sets])
    low = np.array([np.sort(s)[:8] for s in sets])
    for two in (False, True):
        side = (np.arange(70) % 2) * two
        root = rng.integers(0, 50, 70)
        links = set()
        for token in {int(x) for s in sets for x in s[:14]}:
            rows = np.array([i for i, s in enumerate(sets) if token in s])
            if len(rows) > 1:
                pairs = jaccard.bucket_pairs(token, root[rows], n[rows], wide[rows], low[rows], side[rows])
                links |= {(int(rows[i]), int(rows[k])) for i, k in jaccard.similar_links(pairs, root[rows], [sets[i] for i in rows])}
        group, want = {r: r for r in root}, {r: r for r in root}
        for table, pairs in ((group, links), (want, {(i, k) for i in range(70) for k in range(70) if (side[i] != side[k] if two else i < k) and jaccard.similar(sets[i], sets[k])})):
            for i, k in pairs:
                assert jaccard.similar(sets[i], sets[k])
                old, new = table[root[i]], table[root[k]]
                table.update({r: new for r, g in table.items() if g == old})
        same = lambda t: {frozenset(r for r in t if t[r] == g) for g in t.values()}
        if not (two and len(np.unique(side)) < 2):
            assert same(group) == same(want)


def test_layered_spans_by_construction():
    """Secrets in up to four layers of random codes: where they stand is told by each code's own arithmetic."""
    rng = random.Random(11)
    percent = (lambda t: "".join(f"%{b:02x}" for b in t.encode()), lambda a, z: (3 * a, 3 * z))
    unicode_ = (lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda a, z: (6 * a, 6 * z))
    numeric = (lambda t: "".join(f"&#x{ord(c):03x};" for c in t), lambda a, z: (7 * a, 7 * z))
    b64 = (lambda t: base64.b64encode(t.encode()).decode(), lambda a, z: (a // 3 * 4, (z - 1) // 3 * 4 + 4))
    for _ in range(150):
        secret = rng.choice(["password = ", "api_key:", "token="]) + "".join(rng.choices("GHJKMNPQRSTUVWXYZ", k=rng.randrange(12, 30)))
        text, (a, z) = f"see {secret} end", (4, 4 + len(secret))
        for _ in range(rng.randrange(1, 5)):
            encode, place = rng.choice([percent, unicode_, numeric, b64])
            if len(text) > 3000:
                break
            inner = encode(text)
            a, z = place(a, z)
            z = min(z, len(inner))
            before = rng.choice(["", "at ", "~~ "])
            text, a, z = before + inner + " !", a + len(before), z + len(before)
        got = secret_scan.find_secrets(text)[1]
        close = [(s, e) for s, k, e in got if k == 0 and s <= a and e >= z - 3 and a - s < 4 and e - z < 4]
        assert close, (text, a, z, got)


def plain_grams(text, n, lower):
    raw = (text.lower() if lower else text).encode("utf-8", "surrogatepass")
    raw += b" " * (n - len(raw))
    count = [0] * linear.GRAMS
    for i in range(len(raw) - n + 1):
        code = sum(raw[i + k] * (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[k] for k in range(n)) % 2**32
        code ^= code >> 15
        count[(code * 0x2C1B3C6D % 2**32) >> 21] += 1
    return [(c / sum(count)) ** 0.5 for c in count]


def plain_sigmoid(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def plain_margin(x, w):
    return sum(float(a) * float(b) for a, b in zip(x, w, strict=False)) + float(w[-1])


def test_quality_by_hand(spark):
    """Every score from the fitted weights, feature by feature."""
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice(["alpha", "béta", "gamma"]) + ("!" if i % 3 == 0 else "") for _ in range(30)), rng.choice(["en", "fr", None]), f"s{i % 3}") for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    df = table(spark, docs)
    model = quality.fit(df, labels)
    prior = math.log(sum(i % 3 > 0 for i in range(100)) / sum(i % 3 == 0 for i in range(100)))
    assert abs(model.prior - prior) < 1e-9
    for r in rows_of(quality.score_quality(df, model))[:40]:
        _, text, lang, source = docs[r["doc_id"]]
        a = model.text_scale[0] * plain_margin(plain_grams(text, 2, False), model.text) + model.text_scale[1]
        b = model.page_scale[0] * plain_margin(quality.page_features(text, lang, source, len(text)), model.page) + model.page_scale[1]
        for name, x in (("text_score", a), ("page_score", b), ("score", a + b - prior)):
            assert abs(r[name] - plain_sigmoid(x)) < 1e-4
        assert r["quality"] == (r["score"] >= 0.5)


def test_language_by_hand(spark):
    """Families, votes and scores from the fitted weights, feature by feature."""
    rng = random.Random(13)
    words = {"en": "the and with of this", "de": "der und mit von dies", "nl": "de en met van deze", "fr": "le et avec du ce", "es": "el y con del esto", "xx": "zzo qqi kka"}
    docs = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(20)), lang, None) for i, lang in enumerate(list(words) * 30)]
    df = table(spark, docs)
    model = langid.fit(df)
    assert model.langs == sorted(words) and model.families == ["germanic", "other", "romance"]
    for r in rows_of(langid.identify(df, model))[:60]:
        x = plain_grams(docs[r["doc_id"]][1], 3, True)
        p = [plain_sigmoid(plain_margin(x, w)) + 1e-9 for w in model.family_models]
        first = p.index(max(p))
        langs, pairs = model.within[model.families[first]]
        votes, sums, trust = ([0.0] * len(langs) for _ in range(3))
        for i, j, w, (a, b) in pairs:
            m = plain_margin(x, w)
            votes[i if m > 0 else j] += 1
            sums[i], sums[j] = sums[i] + m, sums[j] - m
            trust[i], trust[j] = trust[i] + plain_sigmoid(a * m + b), trust[j] + 1 - plain_sigmoid(a * m + b)
        best = max(range(len(langs)), key=lambda k: (votes[k], sums[k], -k))
        score = p[first] / sum(p) * (trust[best] / (len(langs) - 1) if len(langs) > 1 else 1)
        assert r["lang_pred"] == langs[best] and abs(r["score"] - score) < 1e-3


def test_language_of_many(spark):
    """Every language that is learned can be predicted, however many there are; a hot id counts once."""
    rng = random.Random(14)
    names = [f"q{i:02d}" for i in range(40)]
    own = {n: ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(4)] for n in names}
    docs = [(i, " ".join(rng.choices(own[n], k=12)), n, None) for i, n in enumerate(names * 12)] + [(7, "same text again", "q07", None)] * 500
    df = table(spark, docs)
    model = langid.fit(df)
    got = rows_of(langid.identify(df, model))
    assert set(model.langs) == set(names)
    truth = {i: n for i, _, n, _ in docs[:480]}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] != 7]) > 0.9


def test_media_by_other_means(spark):
    """Stored forms and features as other readers and plain loops have them."""
    import io
    import wave

    texts = [(i, "".join(random.Random(i).choices("aé!\n木 ", k=i * 40)), None, None) for i in range(24)]
    got = {r["doc_id"]: r for r in rows_of(media.read_back(media.store_texts(table(spark, texts))))}
    seen = set()
    for i, text, *_ in texts:
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        kind = media.KINDS[hashlib.sha256(payload).digest()[0] % 3]
        seen.add(kind)
        stored = media.encode(payload, kind)
        assert (got[i]["media_bytes"], got[i]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if kind == "audio/wav":
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(1)
                w.setframerate(8000)
                w.writeframes(payload)
            assert stored == out.getvalue()
        elif kind == "image/bmp":
            assert stored[int.from_bytes(stored[10:14], "little") :] == payload and int.from_bytes(stored[2:6], "little") == len(stored)
        else:
            at = stored.index(b"IDAT")
            lines = zlib.decompress(stored[at + 4 : at + 4 + int.from_bytes(stored[at - 4 : at], "big")])
            assert b"".join(lines[k + 1 : k + 577] for k in range(0, len(lines), 577)) == payload and not any(lines[::577])
        mean = sum(payload) / len(payload)
        assert got[i]["feature"] == f"{kind};samples={len(payload)};mean={mean:.4f};max={max(payload)};corrected={int(kind != 'image/png')};embedded=0"
    assert seen == set(media.KINDS)
