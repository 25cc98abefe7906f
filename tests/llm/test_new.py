"""Vector codes, substring dedup and collocations against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from inkglass.llm import collocations, substring_dedup, vector_codes


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(7)
    rows = [(i, (r.integers(-3, 4, 32) / 8).tolist(), int(i % 3)) for i in range(200)]
    rows += [(i, rows[0][1], None) for i in range(200, 260)] + [(3, rows[5][1], 0), (None, rows[9][1], None), (500, None, 1), (501, [1.0] * 31 + [None], 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] + [0.0] * 31, 2), (504, [1e30] * 32, 2), (505, [0.5] * 5, 2), (506, [], 2)]
    return spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, label int, code long, part long")


def plain_codes(rows, entries):
    kept = [(i, [int(np.floor(256 * min(max(x, -65536.0), 65536.0))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 16)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = np.array([v + [0] * (16 * width - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), 16, width)
    books = m[:entries].transpose(1, 0, 2).copy()
    for k in range(3):
        d = ((m[:, :, None, :] - books[None]) ** 2).sum(-1)
        codes = d.argmin(-1)
        for p in range(16):
            for e in range(len(books[p])):
                if k < 2 and (codes[:, p] == e).any():
                    mine = m[codes[:, p] == e, p]
                    books[p, e] = mine.sum(0) // len(mine)
    return sorted(("".join(f"{c:02x}" for c in row), int(err)) for row, err in zip(codes, d.min(-1).sum(-1), strict=True)), books


def test_vector_codes(spark, vectors):
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    out = vector_codes.vector_codes(vectors).collect()
    want, books = plain_codes(rows, 64)
    assert sorted((r.code, r.error) for r in out) == want and {r.codebooks_sha256 for r in out} == {vector_codes.digest(books)}
    by, label = collections.Counter(), {r.vec_id: r.label for r in vectors.collect()}
    for r in out:
        by[label[r.vec_id]] += r.error
    assert all(r.label_error == by[label[r.vec_id]] for r in out if r.vec_id is not None)


def test_codes_by_salted_join_few_and_none(spark, vectors, monkeypatch):
    whole = vector_codes.vector_codes(vectors).collect()
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert sorted(map(str, vector_codes.vector_codes(vectors).collect())) == sorted(map(str, whole))
    few = vector_codes.vector_codes(vectors.where("vec_id in (1, 2)")).collect()
    assert {r.error for r in few} == {0} and vector_codes.vector_codes(vectors.limit(0)).collect() == vector_codes.vector_codes(vectors.where("vec_id = 500")).collect() == []


def test_bounds_hold_every_nearest_entry():
    r = np.random.default_rng(2)
    for k in (1, 3, 64):
        for spread in (1, 5, 900):
            entries, q = r.integers(-spread, spread + 1, (k, 3)), r.integers(-spread, spread + 1, (500, 3))
            d = ((q[:, None] - entries[None]) ** 2).sum(-1)
            cells = vector_codes.Cells(entries)
            found, best = cells.nearest(q)
            assert (found == d.argmin(1)).all() and (best == d.min(1)).all()
            assert k < 64 or spread < 900 or cells.candidates(q).mean() < 0.5


def plain_cut(texts, width):
    words = [(t or "").encode().split() for t in texts]
    n = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - width + 1) if n[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "shard"), [(3, 20), (5, 8)])
def test_substring_dedup(spark, width, shard):
    """Full sketches (many false alarms) and sparse ones; repeats within a text, over many parts, and in repeated rows."""
    rnd = random.Random(width)
    texts = [" \t\n".join(rnd.choices("abcdefgh", k=rnd.randrange(0, 60))) for _ in range(60)] + [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(50)) for _ in range(40)]
    texts += [None, "", " \n ", texts[70], texts[71].replace("u", "U"), "é 日本 " * 5, "x " * 3000]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)] + [(None, texts[72], 1, 2), (3, texts[3], 1, 2)], "doc_id long, text string, part long, row long").repartition(5)
    out = substring_dedup.without_repeats(df, width, shard).selectExpr("n_words", "n_removed", "sha2(kept_text, 256) h", "aggregate(removed, 0L, (s, x) -> s + x.end - x.start) n").collect()
    assert sorted((r.n_words, r.n_removed, r.h) for r in out) == plain_cut([*texts, texts[72], texts[3]], width) and all(r.n == r.n_removed for r in out)
    assert substring_dedup.without_repeats(df.limit(0)).count() == 0


def plain_phrases(rows, least, top, contained):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        piece, pieces = [], []
        for c in "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "") + ".":
            if c in ".,;:!?\n\x0b\x0c\r":
                pieces.append("".join(piece))
                piece = []
            else:
                piece.append(c)
        for w in ([x for x in p.replace("\t", " ").split(" ") if x] for p in pieces):
            total[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    out = []
    for lang, n in f.items():
        found = []
        for g, a in n.items():
            if len(g) > 1 and a >= least:
                score, _, left, right = min((2000000 * a // (n[g[:k]] + n[g[k:]]), k, n[g[:k]], n[g[k:]]) for k in range(1, len(g)))
                longer = [b for h, b in n.items() if len(h) > len(g) and b >= least and any(h[i : i + len(g)] == g for i in range(len(h)))]
                if not any(100 * b >= contained * a for b in longer):
                    found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("more", [{}, {"hot": 5, "shard": 40}, {"listed": 3, "shard": 100}, {"listed": 0}])
def test_collocations(spark, more):
    """Hot pivots dealt, many shards, words beyond the ranked list, equal pivots in a row."""
    rnd = random.Random(11)
    words = ["the", "The", "of", "sea", "é", "日本", "a-b", "x", "new", "York"]
    texts = [(rnd.choice(["en", "de", None]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rnd.randrange(0, 40)))) for _ in range(150)]
    texts += [("en", "x x x x x x x"), ("en", "new york city of the sea")] * 9 + [("und", "of the of the"), ("en", None), ("en", ""), ("de", ",;.")]
    df = spark.createDataFrame([(k, t, lang, 1, 2) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, key long, n long")
    out = collocations.collocations(df, least=4, top=25, **more).collect()
    assert sorted(tuple(r) for r in out) == plain_phrases(texts, 4, 25, 80)
    assert collocations.collocations(df.limit(0)).count() == 0 == collocations.collocations(df.where("text is null")).count()


def test_scores_pass_64_bits(spark):
    row = spark.sql("select cast(2000000 as decimal(10,0)) * cast(9000000000000000000 as decimal(20,0)) div (cast(9000000000000000000 as decimal(20,0)) + cast(9000000000000000000 as decimal(20,0))) s").first()
    assert row.s == 1_000_000


def test_equal_keys_of_words_are_told_apart(monkeypatch):
    """Words of one key keep their own counts, so that the caller sees both."""
    real = collocations._values
    monkeypatch.setattr(collocations, "_values", lambda seed: np.ones(256, np.uint64) if seed < 1000 else real(seed))
    batch = pa.record_batch([pa.array(["en"]), pa.array(["ab cd " * 10 + "ab"])], names=["lang", "text"])
    rows = [r for b in collocations._counts(1)(iter([batch])) for r in b.to_pylist()]
    assert {r["word"]: r["n"] for r in rows} == {"ab": 11, "cd": 10} and len({r["key"] for r in rows}) == 1


def test_pipeline_against_plain_stages(spark, small):
    """What each stage keeps, from plain versions of its rule over the rows it was given."""
    import corpus_pipeline
    from test_brute import brute_components

    from inkglass.llm import decontaminate, quality, token_store

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        rows.append({r.doc_id: r.text for r in docs.collect()})
    first = spark.read.parquet(f"{small}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.quality(first, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert set(rows[1]) == {i for i in rows[0] if scores[i] == 1}
    groups, _ = brute_components(rows[1], 5, 80)
    assert set(rows[2]) == set(groups.values())
    leaked = {r.doc_id for r in decontaminate.leaks(first.where(first.doc_id.isin([int(i) for i in rows[2]])), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert set(rows[3]) == set(rows[2]) - leaked and set(rows[4]) <= set(rows[3])
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()}
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_store.default_tokenizer())
    assert out == {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows[4].items()}
