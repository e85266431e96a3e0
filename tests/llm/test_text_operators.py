"""Operators that judge or rewrite each text by itself, against plain versions on small tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quire.llm import bpe, chat, language, licenses, pii, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score double"
AWKWARD = [
    "", None, " \n\t ", "a", "Été à la plage, l'été 2024!\n\n  fin", "x" * 20_000, "the cat " * 4000, "日本語のテキスト 😀 é", "\u0000nul\u0000",
    "All rights reserved. Licensed under CC BY-NC 4.0. cc by cc by",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "clash", 0.5) for i, t in enumerate(AWKWARD)] + [(3, "a", "en", "s", 1, None, None), (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# License scans


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = []
    for base, group in ((True, licenses.BASE_TEMPLATES), (False, licenses.TEMPLATES)):
        for label, phrase, whole in group:
            p, w = phrase.split(), whole.split()
            inside = next(k for k in range(len(w)) if w[k : k + len(p)] == p)
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    hit = sum(0 <= at - inside + k < len(words) and words[at - inside + k] == x for k, x in enumerate(w))
                    found.append((at, label, base, hit / len(w)))
    own = [f for f in found if f[2]]
    return (
        len(words), len(own), min((f[0] for f in own), default=None), max((f[0] for f in own), default=None),
        ",".join(sorted({f[1] for f in own})), ",".join(sorted({f[1] for f in found})), max((f[3] for f in found), default=0.0),
    )


def test_licenses_equal_a_plain_scan(spark, docs):
    notices = [w for group in (licenses.BASE_TEMPLATES, licenses.TEMPLATES) for _, _, w in group]
    rng = random.Random(1)
    more = [f"{rng.choice(['', 'Foo bar. '])}{rng.choice(notices).upper()}\n{' '.join(rng.choices('license public cc by all rights mit general'.split(), k=30))}" for _ in range(60)]
    table = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string"), allowMissingColumns=True)
    for r in licenses.license_digest(licenses.scan_licenses(table, keep=("doc_id", "text")), keep=("doc_id", "text")).collect():
        assert tuple(r)[2:] == plain_scan(r["text"]), r["text"]


def test_licenses_of_nothing(empty):
    assert licenses.license_digest(licenses.scan_licenses(empty)).count() == 0


# Chat formatting


def test_chat_reads_back_what_was_formatted(spark):
    rng = random.Random(2)
    scraps = ["\\", "<", ">", "\\l", "\\b", "<turn:user>", "</turn>\n", "<next>", "é😀", "", " ", "\n", "a"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<turn:", "a>b", None]), rng.choice([None, "".join(rng.choices(scraps, k=6))]), "x") for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(5, 0, "assistant", "again", "x"), (5, 0, "assistant", "again", "x"), (None, None, None, None, None)]
    read = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string"))).collect()
    wanted = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read} == wanted
    assert all(r["learned"] == "".join(t for role, t in wanted[r["conv_id"]] if role == "assistant") for r in read)


def test_chat_merges_adjacent_turns_and_marks_the_learned_text(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c<d")]
    r = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    assert r["formatted"] == "<turn:user>a<next>b</turn>\n<turn:assistant>c\\ld</turn>\n"
    assert [b["texts"] for b in r["blocks"]] == [["a", "b"], ["c<d"]]
    assert [s["text"] for s in r["segments"] if s["learned"]] == ["c\\ld"]


def test_chat_of_nothing_has_the_probe(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    (r,) = chat.chat_digest(none).collect()
    assert (r["conv_id"], r["n_turns"], r["loss_chars"]) == (-7, 2, len(chat.PROBE))
    assert r["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest()
    assert chat.format_chats(none).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.DEFAULT_RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_tokenizer_and_round_trips(docs, reference_encoding):
    packed = bpe.bpe_encode(docs, keep=("doc_id", "text"), packed=True)
    arrays = {(r["doc_id"], r["text"]): r["ids"] for r in bpe.bpe_encode(docs, keep=("doc_id", "text")).collect()}
    rows = bpe.bpe_decode(packed, keep=("doc_id", "text", "n_tokens", "ids")).collect()
    assert len(rows) == docs.count()
    small = bpe.bpe_encode(docs, keep=("doc_id", "text"), states=5, cached=3, release=True).collect()
    assert {(r["doc_id"], r["text"]): r["ids"] for r in small} == arrays
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == reference_encoding.encode_ordinary(r["text"] or "") == arrays[r["doc_id"], r["text"]]
        assert r["n_tokens"] == len(ids) and r["decoded"] == (r["text"] or "")


def test_bpe_digest_is_that_of_ids_and_bytes(docs, empty, reference_encoding):
    rows = bpe.bpe_digest(docs, keep=("doc_id", "text")).collect()
    assert len(rows) == docs.count() and bpe.bpe_digest(empty).count() == 0
    for r in rows:
        text = r["text"] or ""
        ids = np.array(reference_encoding.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert (r["decoded_sha256"], r["decoded_chars"]) == (hashlib.sha256(text.encode()).hexdigest(), len(text))


@pytest.mark.parametrize("limit", [10**6, 40, 0])
def test_bpe_transducer_on_random_bytes(monkeypatch, limit):
    monkeypatch.setattr(bpe, "STATE_LIMIT", limit)
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.DEFAULT_RANKS))
    t, rng = bpe.Transducer(ranks), random.Random(3)
    for _ in range(1500):
        piece = bytes(rng.choices(b"aeinorst \xc3\xa9\xe4\xb8\x80x", k=rng.randint(1, 24)))
        assert t.encode(piece) == bpe.merged(piece, ranks)


def test_bpe_streams_text_only_when_characters_are_complete(reference_encoding):
    text = "naïve 日本 😀 end"
    bytes_of = bpe._decoder(public_tokenizers.path(bpe.DEFAULT_RANKS))
    parts = list(bpe.stream_decode(reference_encoding.encode_ordinary(text), bytes_of))
    assert "".join(parts) == text and "�" not in "".join(parts)
    machine = bpe.Utf8Stream()
    assert [machine.feed(bytes([b])) for b in "é😀".encode()] == ["", "é", "", "", "", "😀"]
    assert machine.feed(b"\xf0\x9f", last=True) == "�"


# Language


def test_language_is_learned_and_predicted(spark):
    rng = random.Random(4)
    words = {"en": "the and ing tion that with".split(), "fr": "été que les çà eau tion".split(), "de": "der ung schön und über".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=20)), k) for i, k in enumerate(["en", "fr", "de"] * 30)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_languages(table.where("doc_id < 60"))
    got = language.predict_languages(table.where("doc_id >= 60"), model, keep=("doc_id", "lang")).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)


def test_language_table_equals_written_out_vectors():
    rng = np.random.default_rng(5)
    profiles = rng.normal(size=(2, language.DIMENSIONS))
    table = language._table_of(("a", "b"), profiles)
    codes = np.concatenate(list(language.letter_runs("ein kurzer Satz, été")))
    document = language.bound(codes, language.letter_vectors()).sum(axis=0)
    assert np.allclose(table[codes].sum(axis=0), profiles @ document, rtol=1e-3, atol=1e-2)


def test_language_of_awkward_texts(docs, empty):
    model = language.fit_languages(docs)
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language.predict_languages(docs, model, keep=("doc_id", "text")).collect()}
    assert got[None] == got[""] == got[" \n\t "] == ("und", 0.0)
    assert got["a"][0] == "en"
    assert language.fit_languages(empty) == {}
    assert {r["lang_pred"] for r in language.predict_languages(docs, {}).collect()} == {"und"}
    assert language.predict_languages(empty, model).count() == 0


# Personal data


def plain_base(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_plain_expressions():
    rng = random.Random(6)
    scraps = ["a@b.com", "x_y@c-d.e.f", "@", ".", "_", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-9999", "+", "0", "12", " ", "-", "é", "a.b@", "\n", "5.5.5.5.5.5.5.5"]
    for _ in range(4000):
        text = "".join(rng.choices(scraps, k=rng.randint(0, 12)))
        assert pii.base_spans(text) == plain_base(text), text


def test_pii_keeps_base_spans_and_adds_secrets(spark, docs, empty):
    rng = random.Random(7)
    key = lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    rows = [(i, rng.choice([f"mail me at joe{i}@x.org please", f"the key {key()} is", f'token = "{rng.getrandbits(128):032x}"', f"call +1 (555) 010-{1000 + i}", f"plain words only number {i}", f"path/to-some/thing{i:06d}x/longer here"])) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pii.fit_pii(table)
    got = {r["text"]: r for r in pii.find_pii(table.unionByName(docs, allowMissingColumns=True), model, keep=("doc_id", "text")).collect()}
    for text, r in got.items():
        base = r["base"].split(",") if r["base"] else []
        assert set(base) <= set(filter(None, r["spans"].split(",")))
    keys = [r for t, r in got.items() if t and "AKIA" in t]
    assert keys and all("secret:" in r["spans"] and "AKIA" not in r["redacted"] for r in keys)
    assert all(r["redacted"] == t for t, r in got.items() if t and t.startswith("plain words"))
    assert got[None]["spans"] == got[""]["spans"] == "" and got[None]["redacted"] == ""
    assert pii.find_pii(empty, pii.fit_pii(empty)).count() == 0


def test_pii_secrets_of_any_length(spark):
    rng = random.Random(24)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
    short = lambda: "".join(rng.choices(letters, k=rng.randint(24, 60))) + "1"
    rows = [(i, rng.choice([f'token = "{rng.getrandbits(128):032x}"', f'token = "{short()}"', f"plain words only number {i}", f"path/to-some/thing{i:06d}x/longer here"])) for i in range(900)]
    model = pii.fit_pii(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for n in (128, 129, 130, 256, 1000, 5000):
        for make in (lambda: f"{rng.getrandbits(4 * n):0{n}x}", lambda: "".join(rng.choices(letters, k=n - 1)) + "7"):
            text = f'now token = "{make()}" is set'
            while pii.base_spans(text):  # a card number by chance goes before the run around it
                text = f'now token = "{make()}" is set'
            assert (13, 13 + n, "secret") in pii.proposals(text)
            assert pii.redact(text, pii.all_spans(text, model)) == 'now token = "[SECRET]" is set'
    signed = ".".join("eyJ" + "".join(rng.choices(letters, k=k)) + "1" for k in (40, 300, 342))
    assert [b - a for a, b, kind in pii.proposals(f"bearer {signed}") if kind == "secret"] == [44, 304, 346]


def test_pii_search_is_linear():
    for hard in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 100_000, "a@b." * 50_000):
        pii.base_spans(hard)


def test_pii_proposals_are_linear():
    for hard in ("a1" * 200_000, "a" * 400_000, "a/" * 100_000 + " 1", "1" * 400_000 + "é"):
        for span in pii.proposals(hard):
            assert len(pii.features(hard, span)) == len(pii.FEATURES)


# Quality


def test_quality_is_learned_and_scored(spark, docs, empty):
    rng = random.Random(8)
    words = "lorem ipsum dolor amet the of and to".split()

    def text(good):
        body = [rng.choice(words) for _ in range(60)]
        return " ".join(body) if good else " ".join(w + rng.choice(["!!", "###"]) for w in body) if rng.random() < 0.5 else " ".join(w for w in body for _ in range(4))

    rows = [(i, text(i % 3 > 0), int(i % 3 > 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.fit_quality(table.where("doc_id < 200").drop("quality"), table.where("doc_id < 200").select("doc_id", "quality"))
    got = quality.score_quality(table, model, keep=("doc_id", "quality")).where("doc_id >= 200").collect()
    assert all((r["score"] >= 0.3) == bool(r["quality"]) for r in got)
    odd = quality.score_quality(docs, model, keep=("doc_id", "text")).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_quality(empty, model).count() == 0
    one_class = quality.fit_quality(table.drop("quality"), table.where("quality = 1").select("doc_id", "quality"))
    assert quality.score_quality(table, one_class).where("score < 0.99").count() == 0
    unknown = quality.fit_quality(empty.select("doc_id", "text"), table.where("false").select("doc_id", "quality"))
    assert {r["score"] for r in quality.score_quality(docs, unknown).collect()} == {0.5}


def test_quality_scores_keep_the_share_of_the_classes_in_a_small_sample(spark):
    rng = random.Random(23)
    plain, odd = "lorem ipsum dolor amet the of and to".split(), "zork quux blah".split()
    # The signs of the classes overlap, so that scores in the middle occur.
    rows = [(i, " ".join(rng.choice(odd) if rng.random() < (0.1 if i % 10 else 0.2) else rng.choice(plain) for _ in range(30)), int(i % 10 > 0)) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    labels = table.select("doc_id", "quality")
    scores = {}
    for sample in (8000, 300):
        model = quality.fit_quality(table.drop("quality"), labels.union(labels.where("doc_id % 7 = 0")), sample=sample)
        scores[sample] = {r["doc_id"]: r["score"] for r in quality.score_quality(table, model).collect()}
    full, small = scores[8000], scores[300]
    assert abs(np.mean(list(full.values())) - 0.9) < 0.05
    assert abs(np.mean(list(small.values())) - 0.9) < 0.1
    assert sum((full[i] >= 0.3) != (small[i] >= 0.3) for i in full) < 0.05 * len(full)


def test_pii_models_come_from_all_proposals_and_are_the_same_in_place_and_by_task(spark):
    rng = np.random.default_rng(3)
    keys = ["".join(rng.choice(list("abcdef0123456789"), 24)) for _ in range(40)]
    rows = [(i, f"token = {k}" if i % 2 else f"run {k} of mail{i}@example.org, ssn: {100 + i}-22-{1000 + i}") for i, k in enumerate(keys)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []

    class Counted(pii.Trees):
        rounds_ = 2

        def __init__(self):
            super().__init__(rounds=self.rounds_)

        def fit(self, cuts, rows, hits, sums):
            seen.append(rows)
            return super().fit(cuts, rows, hits, sums)

    before, pii.Trees = pii.Trees, Counted
    try:
        models = [pii.fit_pii(table, in_place=n) for n in (10**6, 0)]
    finally:
        pii.Trees = before
    assert models[0] == models[1] and len(models[0]["trees"]) == 2 and "feature" in models[0]["trees"][0]
    spans = {(tuple(round(float(v), 6) for v in pii.features(t, s)), pii.weak_label(t, s, pii.base_spans(t))) for _, t in rows for s in pii.proposals(t)}
    assert seen[0] == seen[1] and len(spans) / 2 < seen[0] < len(spans)  # two thirds by hash
