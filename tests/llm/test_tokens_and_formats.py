"""Packing, SentencePiece, WARC and chat formatting: exact round trips and brute force."""

import gzip
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataql.llm import chat_format, packing, queries, sentencepiece_codec, warc

TOKENIZER, PIECES = queries.tokenizer_path(queries.TOKENIZER), queries.tokenizer_path(queries.PIECES)
ODD = ["", None, "  ", "The quick, brown FOX's jump!! 3.14", "a\x0bb\x0cc\x1cd\x85e\xa0f", "é é İI ΑΣ. ½ 你好🙂", "<|endoftext|>x <|startoftext|> <|ENDOFTEXT|>. a<|endoftext|>B.", "word. word, word.. 'tis don't", "x" * 5000, "tok en " * 3000]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(rows, TOKENIZER).collect())
    import zlib

    want = []
    for i, t in enumerate(ODD):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert got == want


def check_places(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_is_gapless_and_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs.union(docs.limit(5)).withColumns({"length": F.lit("x"), "rank": F.lit(0)}), TOKENIZER).collect()
    n = check_places(rows, 4096)
    assert n <= np.ceil(sum(r.length for r in rows) / 4096) * 1.02 + 1
    assert packing.pack(docs.filter("false"), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_length(seed):
    rng = np.random.default_rng(seed)
    size = 256
    h = np.zeros(size + 1, np.int64)
    np.add.at(h, np.minimum(size, 1 + rng.exponential((5, 40, 90, 200, 3, 60)[seed], 4000).astype(int)), 1)
    plan = packing.Plan(h, size, 32, 3)
    used = np.zeros_like(h)
    for lengths, repeats in plan.runs:
        assert sum(lengths) <= size
        for n in lengths:
            used[n] += repeats
    assert (used == h).all()
    big = (h[size // 2 + 1 :]).sum()
    assert plan.sequences <= max(big, np.ceil((h * np.arange(size + 1)).sum() / size)) * 1.05 + 1


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 30)), rng.random(12) * 5
    x = packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient < 1e-6).all() and np.allclose(gradient[x > 0], 0, atol=1e-6)


def test_viterbi_is_the_best_of_all_segmentations():
    codec = sentencepiece_codec.Codec(PIECES)
    score = {p: s for p, (n, s, i) in ((k, codec.automaton.get(k)) for k in codec.automaton)}

    def best(text):
        top = -1e300
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            at, parts = 0, []
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            parts.append(text[at:])
            total = 0.0
            for p in parts:
                if p in score:
                    total += score[p]
                elif len(p) == 1:
                    total += codec.unknown_score
                else:
                    total = -1e300
                    break
            top = max(top, total)
        return top

    def value(ids):
        total, run = 0.0, 0
        raw = bytearray()
        for i in ids:
            if i in codec.id_byte:
                raw.append(codec.id_byte[i])
            else:
                total += score[codec.pieces[i]]
        return total + codec.unknown_score * len(raw.decode()) + run

    for t in ("hello", "the▁end", "▁▁▁a▁b", "naïve", "x\ny▁z", "日本", "aaaaaaaa", "▁stations"):
        assert value(codec.viterbi(t)) == pytest.approx(best(t))


def test_sentencepiece_round_trip(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    ids = sentencepiece_codec.encode(rows, PIECES)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(ids, PIECES).collect()}
    assert [back[i] for i in range(len(ODD))] == ODD
    assert all(r.lossless for r in sentencepiece_codec.round_trip(rows, PIECES).collect())
    codec = sentencepiece_codec.Codec(PIECES, cache_limit=3)
    for t in filter(None, ODD[:8]):
        assert codec.encode([t])[0].tolist() == codec.viterbi("▁" + t.replace(" ", "▁"))
    assert sentencepiece_codec.encode(rows.filter("false"), PIECES).count() == 0


PAGES = [(3, "http://a/", "x" * 150), (1, "http://b/\n?", "x" * 150), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (None, "u", "x" * 150), (7, "u", "é\r\n\r\n" * 40)]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, tmp_path, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "size": F.lit("s"), "value": F.lit(0)})
    warc.write(pages, str(tmp_path / "w"), compress=compress, file_rows=2)
    rows = warc.read(spark, str(tmp_path / "w"), payloads=True).collect()
    assert not [r for r in rows if r.record_type == "gap"]
    got = sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, "revisit" if i == 3 else "response", len((t or "").encode()), sha(t), 1 if i == 3 else None) for i, _, t in PAGES]
    assert got == sorted(want, key=repr)
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {t or "" for i, _, t in PAGES if i != 3}
    warc.write(pages.filter("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_without_a_broadcast_and_by_size(spark, tmp_path, monkeypatch):
    """Many repeated digests are joined by id; large payloads lie in files of few records."""
    rows = [(i, "u", f"page {i % 7} " * (40 if i % 5 else 4000)) for i in range(60)] + [(None, "u", "page 3 " * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    both = []
    for few in (warc.FEW, 0):
        out = warc.records(pages, warc.Workspace(spark, "t"), few=few)[0]
        both.append(sorted(r.value for r in out.collect()))
    assert both[0] == both[1]
    warc.write(pages, str(tmp_path / "w"), compress=False, file_rows=10, file_bytes=100_000)
    for f in (tmp_path / "w").glob("part-*"):
        n, size = f.read_bytes().count(b"WARC-Record-ID"), f.stat().st_size
        assert n <= 10 and size < 140_000
    assert warc.read(spark, str(tmp_path / "w")).filter("record_type != 'gap'").count() == 61


def test_version_lines_without_headers_end_soon():
    data = b"WARC/1.1\r\nx: y\r\n" * 20_000
    assert read(data) == ([], [(0, len(data))])


def record(n, body=b"payload " * 20):
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, hashlib.sha256(body).hexdigest().encode(), len(body), body)


def read(data):
    found = list(warc.salvage(data))
    ids = [warc._urn(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)]
    return ids, [(x.offset, x.size) for x in found if isinstance(x, warc.Gap)]


def test_salvage_of_plain_archives():
    a, b, c = record(1), record(2), record(3)
    assert read(a + b + c) == ([1, 2, 3], [])
    assert read(a + b"junk\x1f\x8b\x08" + c) == ([1, 3], [(len(a), 7)])
    broken = b.replace(b"payload", b"pay1oad", 1)
    assert read(a + broken + c) == ([1, 3], [(len(a), len(b))])
    assert read(a + b[:60] + c) == ([1, 3], [(len(a), 60)])
    assert read(b"nothing") == ([], [(0, 7)])
    assert read(b"") == ([], [])


def test_salvage_of_gzip_members():
    members = [gzip.compress(record(i, bytes(np.random.default_rng(i).integers(97, 123, 900, dtype=np.uint8))), mtime=0) for i in range(4)]
    assert read(b"".join(members)) == ([0, 1, 2, 3], [])
    hurt = bytearray(members[1])
    hurt[len(hurt) // 2] ^= 0xFF
    assert read(members[0] + bytes(hurt) + members[2]) == ([0, 2], [(len(members[0]), len(hurt))])
    assert read(members[0] + members[1][:100] + members[2]) == ([0, 2], [(len(members[0]), 100)])
    assert read(members[0] + record(9) + members[1]) == ([0, 9, 1], [])
    many = gzip.compress(b"".join(record(i, bytes(np.random.default_rng(i).integers(97, 123, 3000, dtype=np.uint8))) for i in range(20)), mtime=0)
    ids, gaps = read(many[: len(many) // 2] + members[3])
    assert ids[-1] == 3 and ids[:-1] == list(range(len(ids) - 1)) and len(ids) > 5
    assert gaps == [(0, len(many) // 2)]


def many_records(n=40, size=700):
    bodies = [bytes(np.random.default_rng(i).integers(97, 123, size, dtype=np.uint8)) for i in range(n)]
    return [record(i, b) for i, b in enumerate(bodies)]


def test_salvage_of_a_wrong_crc_in_a_small_member():
    parts = many_records()
    member = bytearray(gzip.compress(b"".join(parts), mtime=0))
    assert len(member) < 65536
    member[-6] ^= 0xFF  # in the check sum; deflate's bytes are all well
    assert read(bytes(member) + gzip.compress(record(99))) == ([*range(40), 99], [(0, len(member))])


@pytest.mark.parametrize("level", [1, 6, 0])
def test_salvage_up_to_a_flipped_byte_in_a_small_member(level):
    import zlib

    parts = many_records()
    ends = np.cumsum([len(p) for p in parts])
    good = gzip.compress(b"".join(parts), level, mtime=0)
    assert len(good) < 65536
    for at in range(40, len(good) - 8, 397):
        member = bytearray(good)
        member[at] ^= 0xFF
        # all bytes that the untouched start of the member stands for
        told = zlib.decompressobj(31).decompress(good[:at])
        whole = int(np.searchsorted(ends, len(told), "right"))
        ids, gaps = read(bytes(member) + gzip.compress(record(99)))
        assert ids[:whole] == list(range(whole)) and ids[-1] == 99


def test_damage_in_a_written_archive_loses_one_record(spark, tmp_path):
    pages = [(i, "u", "".join(map(chr, np.random.default_rng(i).integers(97, 123, 900)))) for i in range(60)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*") if f.stat().st_size]
    assert sum(gzip.decompress(f).count(b"WARC-Record-ID") for f in files) == 60  # any reader of gzip takes it
    data = bytearray(max(files, key=len))
    ids, gaps = read(bytes(data))
    assert not gaps
    data[len(data) // 3] ^= 0xFF
    left, gaps = read(bytes(data))
    assert len(set(ids) - set(left)) <= 1 and set(left) <= set(ids) and len(gaps) == 1


def test_chat_round_trip(spark):
    texts = ["hi", "a < b & c [INST] <|turn|>user\n<|end|>\n &lt; &amp;#91;", "", None, "</s>\n\n[/INST]", "é🙂<|image:0|>"]
    rows = [(i % 3, i, "assistant" if i % 2 else "user\n<x>", t) for i, t in enumerate(texts)] + [(9, None, None, None), (9, 1, "assistant", "z"), (9, 1, "assistant", "z"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = df.withColumn("parts", chat_format.text_part(F.col("text"))).withColumns({"segment": F.lit(1), "at": F.lit(2), "body": F.lit(3)})
    done = chat_format.format_conversations(messages)
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: -1 if r[1] is None else r[1])
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv].loss == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert chat_format.format_conversations(messages.filter("false")).count() == 0


def test_parts_flatten_in_order(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat_format.PART}>"
    parts = [("text", "see <", None, None), ("image", None, "s3://a.png", 785), ("text", None, None, None), ("audio", None, "b.wav", 1280), ("document", None, "c.pdf", None), ("video", "v", "d.mp4", 9), (None, "q", None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("image", None, "e.png", 1)]), (2, 0, "user", None), (2, 1, "user", [])]
    got = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert "see &lt;<|image:0|><|audio:1|><|document:2|><|unknown:3|><|unknown:4|>" in got[1].formatted
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, 0, "image", "s3://a.png", 2), (0, 1, "audio", "b.wav", 2), (0, 2, "document", "c.pdf", 0), (0, 3, "unknown", "d.mp4", 0), (0, 4, "unknown", None, 0), (1, 0, "image", "e.png", 1)]
    assert got[2].formatted == "<|turn|>user\n<|end|>\n" * 2 and got[2].attachments == []
    plan = chat_format.format_conversations(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
