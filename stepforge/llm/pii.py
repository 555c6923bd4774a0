"""Personal data by boosted trees over candidate spans.

Base spans are what the four fixed patterns match, each kind leftmost and without overlaps; they always stay. Generators
propose many more spans, overlapping ones too: every run of digit groups that could be a card, phone or address, whatever
stands beside it, and every local part before an at sign, a bracketed or a spelled one. Trees of each kind, boosted on the
logistic loss, read a candidate's format (groups, separators, sizes, ...) and context (what stands beside it, the word
before), but not what decides the rules of its kind (check digit, plus sign, size of parts): a form of number that is a card
only by chance passes the check digit one time in ten, and scores so. Candidates that are base spans are the examples;
those that break the rules, or cross a base span of their kind, the counterexamples; those that keep the rules beside all
base spans (a card right behind a phone number, say) are left out of the fit, since they are what the trees have to decide.
The threshold of a kind is the lowest at which the precision over all texts is ``PRECISION``, each text scored by trees that
did not see its fold; a kind with fewer than ``LEAST`` examples outside one of the ``FOLDS`` folds gets no more spans. Of the
candidates above it whose shape (sizes and separators) some example has, those with the best scores are added that touch no
base span and no better one; cards and addresses must keep their rules too.

The fit reads every candidate of every text. Spark counts them as distinct (features, label) rows, whose weight is the
logarithm of their count, so that copies of a text cannot outweigh the rest. The edges of the bins come from exact counts of
all values, the trees from histograms of all rows (``boosting.classifiers``), and the thresholds from all scores: sums of
each 1 / ``STEPS`` of their range, then each score within one. The driver gets these sums and the examples' shapes alone.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; repeated rows are judged
alike and each has its row, null doc_ids too; long texts are read whole, in time proportional to their length; an empty
table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.llm import textops
from stepforge.llm.shared import discarded, texts_of, written
from stepforge.operators import boosting

KINDS = ("email", "ip", "card", "phone")
PRECISION, LEAST = 0.98, 20
#: Texts are dealt to so many folds, to be scored by trees that did not see them.
FOLDS = 4
#: Scores are whole numbers of 1 / UNITS; a step of the range holds UNITS / STEPS of them at most.
UNITS, STEPS = 10**9, 10**4
#: Weights are whole numbers of 1 / WEIGHT, so that their sums do not depend on their order.
WEIGHT = 1 << 20
#: Digits and groups of digits of a candidate, and of those that keep the rules of the kind.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
STRICT = {"card": (14, 19), "phone": (10, 15)}
GROUPS = 6

# Fixed patterns. Starts inside a run of digits never match where its own start does not, so they are not tried.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_ZONE = re.compile(r"(?<![0-9])[0-9]++(?:[\x20().+-]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"@|[\[({]at[\])}]|(?<=\x20)at(?=\x20)")
_HOST = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]dot[\])}]|\bdot\b)\x20?[A-Za-z0-9-]{1,63}){1,5}")
_NAME = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?\Z")
_WORD = re.compile(r"([^\W\d_]{1,16})\W{0,3}\Z")

Span = tuple[int, str, int]
#: kind, start, end, whether it keeps the rules of its kind, shape, features.
Candidate = tuple[str, int, int, bool, str, list[int]]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _low(part: str) -> bool:
    """A number of any length that is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, "email", host.end()
            done = host.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """start, kind, end of every base span, by start and then kind."""
    out = list(_emails(text))
    out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(map(_low, m[0].split(".")))]
    for kind, pattern in (("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            digits = "".join(_GROUP.findall(m[0]))
            if STRICT[kind][0] <= len(digits) <= STRICT[kind][1] and (kind == "phone" or luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[1]), span[2]


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ".,;:!?" else 4


def _context(text: str, start: int, end: int) -> list[int]:
    before = _WORD.search(text, max(0, start - 20), start)
    word = zlib.crc32(before[1].lower().encode()) if before else 0
    return [_side(text[start - 1 : start]), _side(text[end : end + 1]), word % 31, word // 31 % 31]


def _numbers(text: str) -> Iterator[Candidate]:
    for zone in _ZONE.finditer(text):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, zone.start(), zone.end())] if zone.end() - zone.start() > 6 else []
        for i, (start, _) in enumerate(groups):
            total = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                total += groups[j][1] - groups[j][0]
                if total > 19:
                    break
                if total < 4:
                    continue
                end, n = groups[j][1], j - i + 1
                between = [text[groups[x][1] : groups[x + 1][0]] for x in range(i, j)]
                address = n == 4 and all(b == "." for b in between)
                kinds = [k for k in ("card", "phone") if DIGITS[k][0] <= total <= DIGITS[k][1]] + ["ip"] * address
                if not kinds:
                    continue
                sizes = [b - a for a, b in groups[i : j + 1]]
                digits = "".join(text[a:b] for a, b in groups[i : j + 1])
                joined = "".join(between)
                plus = text[start - 1 : start] == "+"
                low = address and all(_low(text[a:b]) for a, b in groups[i : j + 1])
                shape = "".join(f"{b}{size}" for b, size in zip(["", *between], sizes))
                near = [min(9, start - groups[i - 1][1]) if i else 9, min(9, groups[j + 1][0] - end) if j + 1 < len(groups) else 9]
                form = [total, n, sizes[0], sizes[-1], max(sizes), min(sizes), *[joined.count(c) for c in " -.("], int(digits[0]), *near]
                for kind in kinds:
                    a = start - 1 if kind == "phone" and plus else start
                    right = {"ip": low, "card": luhn(digits) and STRICT["card"][0] <= total <= STRICT["card"][1], "phone": plus and STRICT["phone"][0] <= total <= STRICT["phone"][1]}[kind]
                    yield kind, a, end, bool(right), shape, [*map(int, form), *_context(text, a, end)]


def _addresses(text: str) -> Iterator[Candidate]:
    for at in _AT.finditer(text):
        name = _NAME.search(text, max(0, at.start() - 65), at.start())
        host = _HOST.match(text, at.end()) if name else None
        if not host:
            continue
        start, local, domain = name.start(), name[0].strip(), host[0]
        # The rest of a longer sentence is no part of a host name: each end after a further part is a candidate.
        for m in re.finditer(r"[A-Za-z0-9-]+", domain):
            seen = domain[: m.end()]
            parts = re.split(r"\x20?(?:\.|[\[({]dot[\])}]|\bdot\b)\x20?", seen.strip())
            if len(parts) < 2:
                continue
            end, last = at.end() + m.end(), parts[-1]
            right = at[0] == "@" and " " not in name[0] + seen and "dot" not in seen.lower()
            form = [len(local), len(seen), len(parts), len(last), last.isalpha(), at[0] == "@", len(at[0]) > 2, local[:1].isalnum(), local[-1:].isalnum()]
            form += [any(c.isdigit() for c in local), seen.count(" "), name[0].endswith(" "), min(len(p) for p in parts), max(len(p) for p in parts), m.end() == len(domain), 0]
            yield "email", start, end, right, f"{at[0]}{len(parts)}{' ' in seen}", [*map(int, form), *_context(text, start, end)]


def candidates(text: str) -> list[Candidate]:
    return [*_addresses(text), *_numbers(text)]


@dataclass(frozen=True)
class Model:
    """Trees, threshold and known shapes of each kind that has them."""

    trees: dict[str, boosting.Boosted] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    shapes: dict[str, frozenset[str]] = field(default_factory=dict)

    def scores(self, kind: str, features: list[list[int]]) -> np.ndarray:
        own = self.trees[kind]
        return 1 / (1 + np.exp(-own.score(own.bins(np.array(features, dtype=float)))))

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, bool, float]]]:
        """kind, start, end, whether it is a base span, and score (1 for base spans) of all spans of each text."""
        out, taken, wanted = [], {}, {k: ([], []) for k in self.trees}
        for i, text in enumerate(texts):
            own = base_spans(text)
            out.append([(kind, a, b, True, 1.0) for a, kind, b in own])
            some = candidates(text) if self.trees else []
            if some:
                taken[i] = bytearray(len(text))
                for a, _, b in own:
                    taken[i][a:b] = b"\1" * (b - a)
            for kind, a, b, right, shape, features in some:
                if kind in wanted and shape in self.shapes[kind] and (right or kind in ("email", "phone")) and taken[i].find(1, a, b) < 0:
                    wanted[kind][0].append((i, a, b))
                    wanted[kind][1].append(features)
        found: dict[int, list] = {}
        for kind, (places, features) in wanted.items():
            for (i, a, b), score in zip(places, self.scores(kind, features) if features else ()):
                if round(float(score), 9) >= self.thresholds[kind]:
                    found.setdefault(i, []).append((-round(float(score), 9), a - b, a, kind, b))
        for i, some in found.items():
            for score, _, a, kind, b in sorted(some):
                if taken[i].find(1, a, b) < 0:
                    taken[i][a:b] = b"\1" * (b - a)
                    out[i].append((kind, a, b, False, -score))
            out[i].sort(key=lambda s: _order((s[1], s[0], s[2])))
        return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.released(batches):
        rows: list[tuple[str, str, bytes, int, int]] = []
        for text in batch.column(0):
            text = text.as_py() or ""
            spans = base_spans(text)
            own, starts = set(spans), [s[0] for s in spans]
            # Spans of one kind do not overlap, so the one that begins last before a place is near enough.
            near = lambda a: [s for s in spans[max(0, bisect_left(starts, a) - 8) : bisect_left(starts, a) + 8]]
            fold = zlib.crc32(text.encode()) % FOLDS
            for kind, a, b, right, shape, features in candidates(text):
                known = (a, kind, b) in own
                if known or not right or any(k == kind and x < b and a < y for x, k, y in near(a)):
                    rows.append((kind, shape, bytes(min(x, 255) for x in features), int(known), fold))
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "shape", "features", "label", "fold"])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows (kind, features) of each kind have each value of each feature."""
    total: dict[str, np.ndarray] = {}
    for block in boosting.blocks(batches):
        for kind in block.column(0).unique().to_pylist():
            own = block.filter(pc.equal(block.column(0), kind)).column(1).to_pylist()
            values = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), -1).astype(np.int64)
            found = np.bincount((values + 256 * np.arange(values.shape[1])).ravel(), minlength=256 * values.shape[1])
            total[kind] = total.get(kind, 0) + found
    for kind, found in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found)), pa.array(np.arange(len(found))), pa.array(found)], ["kind", "cell", "n"])


def _edges(counted: DataFrame) -> dict[str, list[list[float]]]:
    """Edges of the bins of each kind with enough examples."""
    examples = {k: [0] * FOLDS for k in KINDS}
    for r in counted.filter("label = 1").groupBy("kind", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        examples[r["kind"]][r["fold"]] = r["n"]
    enough = [k for k, n in examples.items() if sum(n) - max(n) >= LEAST]
    found = counted.select("kind", "features").mapInArrow(_values, "kind string, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, n = (found.column(c).to_numpy() for c in ("kind", "cell", "n"))
    out = {}
    for k in enough:
        counts = np.zeros(int(cell[kind == k].max()) + 1, np.int64)
        counts[cell[kind == k]] = n[kind == k]
        out[k] = boosting.edges_of_counts(counts.reshape(-1, 256))
    return out


def _binned(counted: DataFrame, edges: dict[str, list[list[float]]]) -> DataFrame:
    """kind, fold, label, weight and bins of all rows, those of the same bins as one."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in boosting.blocks(batches):
            for kind, own in edges.items():
                some = block.filter(pc.equal(block.column("kind"), kind))
                if len(some):
                    values = np.frombuffer(b"".join(some.column("features").to_pylist()), np.uint8).reshape(len(some), -1)
                    bins = boosting.binned(values.astype(float), own)
                    some = some.drop(["features"]).append_column("bins", pa.array([row.tobytes() for row in bins], pa.binary()))
                    yield from some.to_batches()

    units = F.round((1 + F.log2("n")) * WEIGHT).cast("long").alias("units")
    rows = counted.select("kind", "fold", "label", units, "features").mapInArrow(binned, "kind string, fold int, label int, units long, bins binary")
    return rows.groupBy("kind", "fold", "label", "bins").agg(F.sum("units").alias("units")).select("kind", "fold", "label", (F.col("units") / WEIGHT).alias("weight"), "bins")


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds from the base spans of ``docs`` (text); kinds without enough of them have none."""
    counted = texts_of(docs).select(F.col("text").cast("string")).mapInArrow(_labelled, "kind string, shape string, features binary, label int, fold int")
    counted = written(counted.groupBy("kind", "shape", "features", "label", "fold").agg(F.count(F.lit(1)).alias("n")), "pii-candidates")
    edges = _edges(counted)
    if not edges:
        discarded(counted)
        return Model()
    # Read in every round: dealt to all cores.
    rows = written(_binned(counted, edges).repartition(docs.sparkSession.sparkContext.defaultParallelism), "pii-bins")
    models = boosting.classifiers(rows, edges, FOLDS)
    thresholds = _thresholds(rows, models)
    shapes: dict[str, set[str]] = {k: set() for k in thresholds}
    for r in counted.filter("label = 1").select("kind", "shape").distinct().toLocalIterator():
        if r["kind"] in shapes:
            shapes[r["kind"]].add(r["shape"])
    discarded(counted, rows)
    return Model({k: models[k, FOLDS] for k in thresholds}, thresholds, {k: frozenset(own) for k, own in shapes.items()})


def _thresholds(rows: DataFrame, models: dict[boosting.Key, boosting.Boosted]) -> dict[str, float]:
    """The threshold of each kind that has one, from the scores of all rows, each by the trees without its fold."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = {kind: len(model.edges) for (kind, _), model in shared.value.items()}
        for block in boosting.blocks(batches):
            for kind, bins, label, weight, fold in boosting.by_kind(block, features):
                place = np.zeros(len(bins), np.int64)
                for k in range(FOLDS):
                    ours = fold == k
                    place[ours] = np.rint(UNITS / (1 + np.exp(-shared.value[kind, k].score(bins[ours]))))
                columns = [pa.array([kind] * len(place)), pa.array(place), pa.array(label), pa.array(np.rint(weight * WEIGHT).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "place", "label", "units"])

    places = rows.mapInArrow(scored, "kind string, place long, label int, units long").groupBy("kind", "place", "label").agg(F.sum("units").alias("units"))
    places = written(places.withColumn("step", (F.col("place") / (UNITS // STEPS)).cast("int")), "pii-scores")
    good = F.sum(F.col("units") * F.col("label"))
    steps = places.groupBy("kind", "step").agg(good.alias("good"), F.sum("units").alias("every")).orderBy("kind", F.desc("step")).collect()
    examples, above = {}, {}
    for r in steps:
        own = examples.get(r["kind"], (0, 0))
        above[r["kind"], r["step"]] = own
        examples[r["kind"]] = own[0] + r["good"], own[1] + r["every"]

    def lowest(own: pa.Table) -> pa.Table:
        kind, step = own.column("kind")[0].as_py(), own.column("step")[0].as_py()
        place, label, units = (own.column(c).to_numpy() for c in ("place", "label", "units"))
        found = _threshold(place / UNITS, label, units, above=above[kind, step], examples=examples[kind][0])
        return pa.table({"kind": pa.array([kind] * (found is not None), pa.string()), "threshold": pa.array([] if found is None else [found], pa.float64())})

    # A step has at most UNITS / STEPS places.
    found = places.groupBy("kind", "step").applyInArrow(lowest, "kind string, threshold double").groupBy("kind").agg(F.min("threshold").alias("threshold")).collect()
    discarded(places)
    return {k: r["threshold"] for k in KINDS for r in found if r["kind"] == k}


def _threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray, precision: float = PRECISION, above: tuple[float, float] = (0, 0), examples: float | None = None) -> float | None:
    """The lowest score such that those at least as high are right so often, and at least half of the examples are among them.

    ``above`` are the weights of the examples and of all rows whose scores are higher than these, ``examples`` that of all examples."""
    order = np.argsort(-score, kind="stable")
    good, every = above[0] + np.cumsum((weight * label)[order]), above[1] + np.cumsum(weight[order])
    last = np.append(score[order][1:] != score[order][:-1], True)
    ok = np.flatnonzero(last & (good >= precision * every) & (2 * good >= (good[-1] if examples is None else examples)))
    return max(0.5, float(score[order][ok[-1]])) if len(ok) else None


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans of each row of ``docs`` (doc_id, text), in their order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.released(batches):
            found = shared.value.spans([t.as_py() or "" for t in batch.column(1)])
            names = ("kind", "start", "end", "base", "score")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(names, s)) for s in own] for own in found], kind)], ["doc_id", "spans"])

    rows = texts_of(docs).select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(spans, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span (as ``find`` gives them) as its kind in brackets; of overlapping spans the union as the first."""

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        kept = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(fresh, kept).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[of(kind).alias(f"n_{kind}") for kind in KINDS], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
