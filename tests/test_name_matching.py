"""Names inside names against a plain loop."""

import random
import re

from quire.operators import maintenance as M


def bare(name):
    return re.sub(r"(?i)\.pdf$", "", name)


def plain(refs, docs):
    out = {}
    for session, ref in set(refs):
        if ref is None:
            continue
        fits = [
            (pos, i, name) for s, i, name, pos in docs
            if s == session and name is not None and any(x in y or y in x for x, y in ((ref, name), (bare(ref), bare(name))))
        ]
        if fits:
            _, i, name = min(fits)
            out[session, ref] = (i, name, "exact" if name == ref else "without_extension" if bare(name) == bare(ref) else "contained")
    return out


def matched(spark, refs, docs):
    rows = M.match_document_names(
        spark.createDataFrame(refs, "session_id string, ref string"), spark.createDataFrame(docs, "session_id string, doc_id long, doc_name string, position long"),
    ).collect()
    return {(r["session_id"], r["ref"]): (r["doc_id"], r["doc_name"], r["rule"]) for r in rows}


def test_names_equal_a_loop(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(0, 6))) + rng.choice(["", ".pdf", ".PDF"])
    docs = [(f"s{rng.randrange(3)}", i, word(), rng.randrange(20)) for i in range(60)] + [("s3", 90, "", 1), ("s3", 91, "ab", 2), ("s3", 92, None, 0), ("s4", 93, ".pdf", 0)]
    refs = [(f"s{rng.randrange(5)}", word()) for _ in range(80)] + [("s3", ""), ("s3", "ab"), ("s3", None), ("s0", "b" * 20), ("s9", "ab")]
    assert matched(spark, refs, docs) == plain(refs, docs)


def test_long_names_and_few_lengths(spark):
    long = ["".join(random.Random(n).choices("abcd", k=255)) for n in range(30)]
    docs = [("s", n, f"{name}.pdf", n) for n, name in enumerate(long)]
    refs = [("s", name[40:140]) for name in long] + [("s", "x" + name + ".pdf") for name in long]
    assert matched(spark, refs, docs) == plain(refs, docs)
    names = spark.createDataFrame([("s", n) for n in long], "session_id string, name string")
    keys = spark.createDataFrame([("s", r) for _, r in refs[:30]], "session_id string, key string")
    # one length on the other side: a row per place, not one per pair of places
    assert M._parts(names, "name", keys, "key").count() == 30 * (255 - 100 + 1)


def test_empty_tables(spark):
    assert matched(spark, [], [("s", 1, "a", 0)]) == {} == matched(spark, [("s", "a")], [])
