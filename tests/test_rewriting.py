"""Edits and their way back, budgets, payloads, encoders."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkglass.operators import edits, encoding, rewriting


def plain_edit(text, items):
    """(text or None, problem) by looking for each wording in turn."""
    out, cursor = text, 0
    for _, original, new in sorted(items, key=lambda x: text.find(x[1])):
        at = out.find(original, cursor)
        if original == "" or at < 0 or out.find(original, at + 1) >= 0:
            return None
        out, cursor = out[:at] + new + out[at + len(original) :], at + len(new)
    return out


def test_edits_and_their_way_back(spark):
    rnd = random.Random(2)
    texts = {k: "".join(rnd.choice("abcd ") for _ in range(rnd.randrange(4, 30))) for k in range(120)}
    items = {k: [(f"p{i}", t[(s := rnd.randrange(len(t))) : s + rnd.randrange(1, 5)], rnd.choice(["", "X", "ab", "long new"])) for i in range(rnd.randrange(4))] for k, t in texts.items()}
    items[0] = [("p0", "", "x")]
    docs = spark.createDataFrame([*texts.items(), (500, None)], "doc_id long, text string")
    rows = spark.createDataFrame([(k, *e) for k, v in items.items() for e in v], "doc_id long, passage_id string, original string, new string")
    out = edits.edited(docs, rows).withColumn("back", edits.restore(F.col("text"), F.col("applied"))).withColumn("touched", edits.restore(F.concat(F.lit("#"), "text"), F.col("applied"))).collect()
    applied = 0
    for r in out:
        if r.doc_id == 500:
            assert r.text is None
            continue
        want = plain_edit(texts[r.doc_id], items[r.doc_id])
        assert r.text == (texts[r.doc_id] if want is None else want) and (r.problem is None) == (want is not None) and r.back == texts[r.doc_id]
        applied += len(r.applied)
        assert (len(r.applied) == len(items[r.doc_id])) == (want is not None) or not items[r.doc_id]
    assert applied > 30 and {r.problem.split(":")[0] for r in out if r.problem} == {"empty", "not_found", "ambiguous"}
    assert sum(r.touched is None for r in out if r.applied and any(e.new for e in r.applied)) > 10


def test_evidence_within_a_budget(spark):
    def block(passages, budget):
        return spark.createDataFrame([(passages, budget)], "p array<string>, b int").select(rewriting.evidence_block(F.col("p"), F.col("b"))).first()[0]

    assert block(["a" * 100, "b" * 100], 300) == f"[1] {'a' * 100}\n[2] {'b' * 100}" and block([], 300) == ""
    assert block(["a" * 200, "b" * 100, "c"], 10) == f"[1] {'a' * 200}\n[2] {'b' * 56} …"
    assert block(["a" * 250 + " " * 20 + "z", "bcdefgh"], 256) == f"[1] {'a' * 250} …\n[2] bcde …"
    whole = spark.range(1).select(rewriting.prompt(F.lit("Clarify."), F.lit("A claim."), F.lit(None), F.lit(None), F.array(F.lit("Proof.")), F.lit(300))).first()[0]
    assert "Claim: A claim." in whole and "(none)" in whole and "[1] Proof." in whole and "Source" not in whole


GOOD = {"rewritten_text": " New {words} \"here\" ", "reason": "r", "citation_preserved": True, "warnings": ["", "w"]}
REPLIES = {
    "fenced": ("Here:\n```json\n" + json.dumps(GOOD) + "\n``` {not} this", "success"), "bare": (json.dumps(GOOD), "success"), "none": (None, "provider_error"), "words": ("no object here }", "invalid_response"), "open": ('{"rewritten_text": "a"', "invalid_response"),
    "refused": ("I'm sorry, but " + json.dumps(GOOD), "refused"), "long": (json.dumps(GOOD | {"rewritten_text": "x" * 1001}), "invalid_response"), "blank": (json.dumps(GOOD | {"rewritten_text": "  "}), "invalid_response"),
    "number": (json.dumps(GOOD | {"rewritten_text": 5}), "invalid_response"), "word": (json.dumps(GOOD | {"citation_preserved": "true"}), "invalid_response"), "warns": (json.dumps(GOOD | {"warnings": ["a", 1]}), "invalid_response"),
    "empty": (json.dumps(GOOD | {"warnings": []}), "success"), "missing": (json.dumps({k: v for k, v in GOOD.items() if k != "reason"}), "invalid_response"), "doi": (json.dumps(GOOD | {"rewritten_text": "See 10.1234/abc."}), "invalid_response"),
    "known": (json.dumps(GOOD | {"rewritten_text": "See 10.9999/ok, (Lee, 2020) https://a.org/x."}), "success"), "year": (json.dumps(GOOD | {"rewritten_text": "As (Lee, 1999) has it"}), "invalid_response"), "brace": (json.dumps(GOOD | {"reason": "}{\\\"}"}), "success"),
}


def test_replies(spark):
    df = spark.createDataFrame([(k, r) for k, (r, _) in REPLIES.items()], "k string, reply string")
    context = F.lit("From 2020: 10.9999/ok and https://a.org/x in full.")
    out = {r.k: r.o for r in df.select("k", rewriting.outcome(F.col("reply"), context).alias("o")).collect()}
    assert {k: o.status for k, o in out.items()} == {k: s for k, (_, s) in REPLIES.items()}
    assert out["fenced"].rewritten_text == 'New {words} "here"' and out["doi"].invented == ["10.1234/abc"] and out["year"].invented == ["1999"]
    p = df.where("k = 'bare'").select(rewriting.payload(F.col("reply")).alias("p")).first().p
    assert (p.reason, p.citation_preserved, p.warnings) == ("r", True, ["w"])


def hashing(dimension):
    def open_():
        def encode(texts):
            return np.array([[(hash_ >> k) % 7 - 3 for k in range(dimension)] for hash_ in (sum(map(ord, t)) * 2654435761 % 2**32 for t in texts)], np.float32)

        return encode

    return open_


def test_texts_are_encoded_once(spark, tmp_path):
    path, more = f"file://{tmp_path}/vectors", {"model": "m", "dimension": 4}
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string")
    first = {r.id: r.vector for r in encoding.encoded(df, path, hashing(4), **more).collect()}
    assert first[1] == first[3] != first[2] and first[4] is None and abs(sum(x * x for x in first[1]) - 1) < 1e-6
    assert spark.read.parquet(path).count() == 3

    def never():
        raise AssertionError("nothing is left to encode")

    assert {r.id: r.vector for r in encoding.encoded(df, path, never, **more).collect()} == first
    with pytest.raises(Exception, match="not \\(1, 5\\)"):
        encoding.encoded(df.where("id = 1"), path, hashing(4), "other", 5).collect()
    assert encoding.encoded(df.limit(0), f"file://{tmp_path}/none", never, **more).count() == 0
