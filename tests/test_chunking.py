import random

from quire import fixed_values as V
from quire.operators import chunking as C


def brute_split(text, separators, size, overlap):
    """A plain statement of the splitting rule, for comparison only."""
    sep, rest = "", []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1:]
            break
    if sep == "":
        parts = list(text)
    else:
        raw = text.split(sep)
        parts = [p for p in [raw[0]] + [sep + r for r in raw[1:]] if p]
    out, run = [], []
    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        out += brute_pack(run, size, overlap)
        run = []
        out += brute_split(p, rest, size, overlap) if rest else [p]
    return out + brute_pack(run, size, overlap)


def brute_pack(parts, size, overlap):
    out, held, total = [], [], 0
    for p in parts:
        if total + len(p) > size and held:
            out.append("".join(held).strip())
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held).strip())
    return [o for o in out if o]


def test_recursive_matches_brute_force(spark):
    rng = random.Random(7)
    alphabet = ["ab", "cde", " ", " ", " ", ". ", "\n", "\n\n", "\n\n\n\n", "! ", "? ", "; ", "longwordlongwordlongword", "x" * 45]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(60)] + ["", "a", " ", "z" * 95]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in C.chunk_recursive(rows, 40, 10).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    for i, t in enumerate(texts):
        want = brute_split(t, [*V.SEPARATORS, ""], 40, 10) if t else []
        assert got.get(i, []) == want, repr(t)
        assert all(len(c) <= 40 for c in got.get(i, []))


def test_fixed_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = [r["content"] for r in C.chunk_fixed(rows, 100, 20).orderBy("chunk_index").collect()]
    assert parts[0] + "".join(p[20:] for p in parts[1:]) == text


def test_pages(spark):
    rows = spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(["a --- Page 1 --- b --- Page 3 ---", "plain", "--- Page 0 ---", "end"])],
        "doc_id long, chunk_index int, content string",
    )
    pages = spark.createDataFrame([(1, 2)], "doc_id long, page_count int")
    found = [r["page_number"] for r in C.assign_pages(rows, pages).orderBy("chunk_index").collect()]
    assert found == [2, 0, 0, 1]
    assert [r["page_number"] for r in C.assign_pages(rows).orderBy("chunk_index").collect()] == [2, 0, 0, 1]


def test_long_runs_of_blank_lines_merge_alike(spark):
    wanted = None
    for breaks in (300, 1400):
        text = "a" * 30 + "\n" * breaks + "b" * 30 + "\n\n" + "c" * 30
        rows = spark.createDataFrame([(1, "s", text)], "doc_id long, session_id string, text string")
        got = [r["content"] for r in C.chunk_recursive(rows, 100, 0).orderBy("chunk_index").collect()]
        wanted = wanted or got
        assert got == wanted and got[-1].endswith("b" * 30 + "\n\n" + "c" * 30)
