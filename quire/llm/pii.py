"""Personal data: high-recall span generators, boosted trees, calibrated thresholds.

Four kinds have a fixed definition (``base_spans``) and are always redacted.
Generators propose many more, overlapping spans: anything that looks like a
number in groups, an address, an assignment of a secret, or a token of mixed
characters. Boosted trees score each proposal from its format and its context;
the trees are fitted on the proposals of all documents, whose labels
are the base definitions and a few unmistakable key formats. A proposal passes
if its calibrated score reaches its kind's threshold and no span chosen before
overlaps it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, texts_of
from quire.session import cut_lineage, discard

#: Kinds in the order of output; the first four have a fixed definition.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]

_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = re.compile(_LOCAL + r"+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_AT_RUN = re.compile(f"(?<!{_LOCAL})" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches in linear time: a match begins at the start
    of a run of local characters, or where the match before ended inside one."""
    end = 0
    while True:
        m = (_EMAIL.match(text, end) if end else None) or _EMAIL_AT_RUN.search(text, end)
        if m is None:
            return
        yield m.span()
        end = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the four fixed kinds, by start and then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((*m.span(), "phone"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


# Generators. Each has the kind that a proposal gets if it passes.
_PROPOSERS = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}(?:@| ?[\[(](?:at|AT)[\])] ?)[\w-]{1,63}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[\w-]{2,63}){1,4}")),
    ("number", re.compile(r"(?<![\w+])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){3,7}(?![\w])")),
    ("number", re.compile(r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+")),
)
#: Features that follow a span's length count at most so many characters, so a longer run is judged like one of this length.
LONGEST = 128
#: Beginnings of well-known keys, which need not hold a digit.
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-")
_DIGIT = re.compile("[0-9]")
_SPELT_AT = re.compile(r"[\[(](?:at|AT)[\])]")
_KEY_WORD = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwort|api[ _-]?key|credential|bearer)[\"']?[\x20]*[=:]?[\x20]*[\"']?$")
_KEY_FORMAT = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}")
_KEY = re.compile(f"(?<![A-Za-z0-9_-])(?:{_KEY_FORMAT.pattern})(?![A-Za-z0-9_-])")
_NUMBER_WORD = re.compile(r"(?i)(?:iban|ssn|social security|konto|cuenta|compte|passport|ausweis)[^0-9A-Z]{0,12}$")

FEATURES = (
    "kind", "length", "digits", "upper", "lower", "other", "distinct", "entropy", "changes", "longest_run",
    "groups", "key_word_before", "number_word_before", "assigned", "quoted", "hex_only", "known_prefix", "at_line_start", "luhn", "word_like",
)


def proposals(text: str) -> list[Span]:
    """Every span of the generators; they may overlap. Linear in the text: each has a bounded length, or is a whole run taken once.

    All but addresses and keys of a known beginning hold a digit, so most texts need no search.
    """
    own = _PROPOSERS if _DIGIT.search(text) else _PROPOSERS[:1] if "@" in text or _SPELT_AT.search(text) else ()
    if any(k in text for k in _KEY_STARTS):
        own = (*own, ("secret", _KEY))
    if not own:
        return []
    out = list({(*m.span(), kind) for kind, p in own for m in p.finditer(text)})
    out.sort(key=lambda s: (s[0], -s[1], KINDS.index(s[2])))
    return out


def features(text: str, span: Span) -> list[float]:
    a, b, kind = span
    s = text[a:b]
    n, most = len(s), min(len(s), LONGEST)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    counts = np.array([s.count(c) for c in set(s)], float) / n
    before = text[max(0, a - 24) : a]
    runs = re.findall(r"[a-z]+", s.lower())
    return [
        KINDS.index(kind), most, *(kinds.count(k) / n for k in "dulo"), len(counts) / most, float(-(counts * np.log2(counts)).sum()),
        sum(x != y for x, y in zip(kinds, kinds[1:])) / n, min(max(map(len, re.findall(r"[A-Za-z]+|[0-9]+", s)), default=0), LONGEST),
        1 + (len(re.split(r"[\x20.-]", s)) - 1) * (most / n), bool(_KEY_WORD.search(before)), bool(_NUMBER_WORD.search(before)),
        before.rstrip(" \"'")[-1:] in ("=", ":"), before[-1:] in ("'", '"'), bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", s)),
        bool(_KEY_FORMAT.fullmatch(s)), before[-1:] in ("", "\n"), len(_digits(s)) > 11 and luhn(_digits(s)), min(max(map(len, runs), default=0) / most, 1.0),
    ]


def weak_label(text: str, span: Span, base: list[Span]) -> int:
    """1 where a fixed definition, a known key format or a naming word says so, else 0."""
    a, b, kind = span
    s, before = text[a:b], text[max(0, a - 24) : a]
    if any(a < y and x < b for x, y, _ in base):
        return 1
    if kind == "secret":
        strong = len(set(s)) >= 8 and bool(re.search("[0-9]", s))
        return int(bool(_KEY_FORMAT.fullmatch(s)) or strong and bool(_KEY_WORD.search(before)))
    if kind == "number":
        return int(bool(_NUMBER_WORD.search(before)))
    return int(kind == "phone" or "@" in s)


class Trees:
    """Gradient-boosted regression trees for a yes/no label, on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> None:
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.start = 0.0
        self.trees: list[dict] = []

    def fit(self, cuts: list[np.ndarray], rows: int, hits: int, sums: Callable[[Trees, dict], np.ndarray]) -> Trees:
        """``sums`` gives the sums of gradients and curvatures per leaf, feature and bin of the tree being grown (``leaf_sums``)
        over all rows, so no row is needed here; ``rows`` and ``hits`` are how many there are and how many of label 1."""
        share = (hits + 0.5) / (rows + 1)
        self.start = math.log(share / (1 - share))
        for _ in range(self.rounds if 0 < hits < rows else 0):
            tree = {"leaf": 0}
            for depth in range(self.depth):
                leaves = _leaves_of(tree)
                if not leaves:
                    break
                total = sums(self, tree)
                for n, leaf in enumerate(leaves):
                    self._split(leaf, total[n], cuts, last=depth + 1 == self.depth)
                for n, leaf in enumerate(_leaves_of(tree)):
                    leaf["leaf"] = n
            self.trees.append(tree)
        return self

    def _split(self, node: dict, total: np.ndarray, cuts: list[np.ndarray], last: bool) -> None:
        """Make ``node`` a test of its best cut with two leaves below, or a value where none gains."""
        g, h, n = total[:, 0].sum(axis=1)  # every feature's bins hold all rows
        best = (1e-6, None, None)
        for f in range(total.shape[1]) if n > 8 else ():
            if not len(cuts[f]):
                continue
            left_g, left_h = (np.cumsum(part[f, : len(cuts[f]) + 1])[:-1] for part in total[:2])
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        node.clear()
        if best[1] is None:
            node["value"] = float(self.rate * g / (h + 1))
            return
        _, f, k = best
        low = total[:, f, : k + 1].sum(axis=1)
        node.update(feature=f, cut=float(cuts[f][k]))
        for side, (sg, sh, _) in (("low", low), ("high", np.array([g, h, n]) - low)):
            node[side] = {"value": float(self.rate * sg / (sh + 1))} if last else {"leaf": 0}

    def _apply(self, tree: dict, x: np.ndarray, key: str = "value") -> np.ndarray:
        if "feature" not in tree:
            return np.full(len(x), tree.get(key, -1))
        return np.where(x[:, tree["feature"]] <= tree["cut"], self._apply(tree["low"], x, key), self._apply(tree["high"], x, key))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x))))))


def _leaves_of(tree: dict) -> list[dict]:
    """The leaves still to be split, from low to high."""
    if "feature" in tree:
        return _leaves_of(tree["low"]) + _leaves_of(tree["high"])
    return [tree] if "leaf" in tree else []


#: Bins of a feature, and what a gradient is counted in: whole numbers add up the same in every order.
BINS, UNIT = 32, 1 << 24
#: Distinct proposals of which the sums are taken in place; of more, every task sums its own. The sums, and so the trees, are the same.
IN_PLACE = 20_000


def leaf_sums(trees: Trees, tree: dict, cuts: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(leaf, 3, feature, bin) of the rows: sums of gradients and curvatures in units, and numbers of rows."""
    p = trees.score(x)
    leaf = trees._apply(tree, x, "leaf").astype(np.int64)
    out = np.zeros((len(_leaves_of(tree)), 3, len(cuts), BINS), np.int64)
    open_ = np.flatnonzero(leaf >= 0)
    parts = np.rint((y - p) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64), np.ones(len(y), np.int64)
    for f, cut in enumerate(cuts):
        at = np.searchsorted(cut, x[open_, f], side="left")
        for k, part in enumerate(parts):
            np.add.at(out[:, k, f], (leaf[open_], at), part[open_])
    return out


def _threshold(cells: np.ndarray, many: np.ndarray, hits: np.ndarray, precision: float) -> float:
    """The lowest score from which on the held-back precision is reached; over 1 if none is. Scores are counted in cells."""
    order = np.argsort(-cells)
    good = np.flatnonzero(np.cumsum(hits[order]) >= precision * np.cumsum(many[order]))
    return float(cells[order][good[-1]]) / SCORE_CELLS if len(good) else 2.0


#: Cells that scores are counted in to find a threshold.
SCORE_CELLS = 1 << 14


def fit_pii(docs: DataFrame, precision: float = 0.98, text: str = "text", in_place: int = IN_PLACE) -> dict:
    """Trees and thresholds from the distinct proposals of all documents.

    Every one counts: the bins' borders are quantiles of all, each split of a tree is chosen by
    sums over all, and thresholds by counts over all that are held back (a third, by hash). What
    reaches the driver are sums per leaf, feature and bin and counts per kind and cell of the score,
    whose number doesn't depend on the rows; up to ``in_place`` rows are summed there instead, with the same result.
    """

    def propose(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for t in texts_of(batch.column(0)):
            if spans := proposals(t):
                base = base_spans(t)
                rows += [[round(float(v), 6) for v in features(t, s)] for s in spans]
                labels += [weak_label(t, s, base) for s in spans]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["features", "label"])

    made = map_batches(docs.select(docs[text].cast("string").alias("_text")), propose, "features array<double>, label int")
    stored = cut_lineage(made.distinct().withColumn("back", F.pmod(F.xxhash64("features", "label"), F.lit(3)) == 0))
    try:
        return _fitted(stored, precision, in_place)
    finally:
        discard(stored)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def _fitted(stored: DataFrame, precision: float, in_place: int) -> dict:
    taught = stored.where("not back")
    steps = [float(q) for q in np.linspace(0, 1, BINS + 1)[1:-1]]
    one = taught.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("hits"),
        *[F.percentile_approx(F.col("features")[i], steps, 10_000).alias(f"_{i}") for i in range(len(FEATURES))],
    ).first()
    cuts = [np.unique(np.array(one[f"_{i}"] or [], float)) for i in range(len(FEATURES))]
    local = None
    if one["rows"] <= in_place:
        local = taught.select("features", "label").toArrow().combine_chunks()
        local = _matrix(local.column("features").combine_chunks()), local.column("label").to_numpy().astype(float)

    def sums(trees: Trees, tree: dict) -> np.ndarray:
        shape = (len(_leaves_of(tree)), 3, len(cuts), BINS)
        if local is not None:
            total = leaf_sums(trees, tree, cuts, *local)
        else:
            def each(batches):
                own = np.zeros(shape, np.int64)
                for batch in batches:
                    own += leaf_sums(trees, tree, cuts, _matrix(batch.column("features")), batch.column("label").to_numpy().astype(float))
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.ravel()[at])], names=["cell", "n"])

            total = np.zeros(math.prod(shape), np.int64)
            for r in taught.select("features", "label").mapInArrow(each, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
                total[r["cell"]] = r["n"]
        return total.reshape(shape) / np.array([UNIT, UNIT, 1]).reshape(1, 3, 1, 1)

    trees = Trees().fit(cuts, one["rows"], one["hits"], sums)

    def score(batches):
        for batch in batches:
            x = _matrix(batch.column("features"))
            cell = np.floor(trees.score(x) * SCORE_CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int64)), pa.array(cell), batch.column("label")], names=["kind", "cell", "label"])

    scored = stored.where("back").select("features", "label").mapInArrow(score, "kind long, cell long, label int")
    counts = np.array([tuple(r) for r in scored.groupBy("kind", "cell").agg(F.count("*"), F.sum("label")).collect()], np.int64).reshape(-1, 4)
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = counts[counts[:, 0] == k]
        thresholds[kind] = max(0.5, _threshold(*own[:, 1:].T, precision)) if len(own) else 0.9
    return {"start": trees.start, "trees": trees.trees, "thresholds": thresholds}


def all_spans(text: str, model: dict) -> list[Span]:
    """Base spans, and of the other proposals those that pass and overlap none taken before (best score first)."""
    taken = base_spans(text)
    spans = [s for s in proposals(text) if not any(s[0] < b and a < s[1] for a, b, _ in taken)] if len(taken) < 64 else _apart(proposals(text), taken)
    if spans:
        trees = Trees()
        trees.start, trees.trees = model["start"], model["trees"]
        score = trees.score(np.array([features(text, s) for s in spans], float))
        passed = [(-p, s) for p, s in zip(score.tolist(), spans) if p >= model["thresholds"][s[2]]]
        free = np.ones(len(text), bool)
        for _, (a, b, kind) in sorted(passed):
            if free[a:b].all():
                free[a:b] = False
                taken.append((a, b, kind))
        taken.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return taken


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of ``taken``, for long lists."""
    used = np.zeros(max(s[1] for s in (*spans, *taken)) + 1, np.int64) if spans else np.zeros(1, np.int64)
    for a, b, _ in taken:
        used[a:b] = 1
    total = np.concatenate(([0], np.cumsum(used)))
    return [s for s in spans if total[s[1]] == total[s[0]]]


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; where spans overlap, the first covers both."""
    out, end = [], 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
            end = b
        elif b > end:
            end = b
    return "".join(out) + text[end:]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_pii(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, counts of the base kinds, ``base`` and ``spans`` (kind:start:end, code points), ``redacted`` text.

    Null counts as an empty text, which has no span. Each row stands for itself:
    repeated rows repeat the result, an empty table gives an empty one, and
    columns not named are ignored. ``model`` (a few kilobytes) comes from ``fit_pii``.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {k: [] for k in BASE}
        base, spans, redacted = [], [], []
        for t in texts_of(batch.column("_text")):
            own = base_spans(t)
            for k in BASE:
                counts[k].append(sum(s[2] == k for s in own))
            every = all_spans(t, model)
            base.append(_joined(own))
            spans.append(_joined(every))
            redacted.append(redact(t, every))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), *(pa.array(counts[k], pa.int64()) for k in BASE), *(pa.array(v, pa.string()) for v in (base, spans, redacted))],
            names=[*keep, *(f"n_{k}" for k in BASE), "base", "spans", "redacted"],
        )

    return map_batches(
        docs.select(*keep, docs[text].cast("string").alias("_text")), find,
        f"{kinds}, {', '.join(f'n_{k} bigint' for k in BASE)}, base string, spans string, redacted string",
    )
