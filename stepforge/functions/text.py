"""Text and key expressions, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def jaccard(left: Column, right: Column) -> Column:
    """Of two token arrays as sets; 0 where either is empty."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds; 0 for an empty query."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, F.array_distinct(text))) / F.size(q))


def bigrams(words: Column) -> Column:
    """Consecutive token pairs as 'a b' strings."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def url_local(url: Column) -> Column:
    """path[?query][#fragment] without scheme and host; '' stays '', an empty rest is '/'."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).when(rest == "", F.lit("/")).otherwise(rest)


def url_path(url: Column) -> Column:
    """The path alone; '' for an empty url."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    """Runs of other characters than [A-Za-z0-9._-] become '_'; ends lose '._-'; nothing left is 'unknown'."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", ""), F.lit("")), F.lit("unknown"))


def feature_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def without_ids(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: The labels of a key's parts, and the text before a step's number.
LABELS = ("goal", "state", "context", "progress")
STEP = "step_till_now:"


def full_key(goal: Column, state: Column, context: Column, progress: Column) -> Column:
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit(""))) for label, c in zip(LABELS, (goal, state, context, progress))])


def _between(text: Column, label: str, following: tuple[str, ...]) -> Column:
    """What stands, without the blanks around it, after ``label`` and before the first of the ``following`` labels; '' where one is missing."""
    opening = F.lit(f"{label}: ") if label == LABELS[0] else F.lit(f" | {label}: ")
    at = F.instr(text, opening)
    rest = F.substring(text, at + F.length(opening), F.length(text))
    ends = [F.nullif(F.instr(rest, F.lit(f" | {name}:")), F.lit(0)) for name in following]
    end = F.least(*ends) if len(ends) > 1 else ends[0] if ends else F.length(rest) + 1
    return F.when((at > 0) & end.isNotNull() & ((at == 1) | F.lit(label != LABELS[0])), F.regexp_replace(F.substring(rest, F.lit(1), end - 1), r"^\s+|\s+$", "")).otherwise(F.lit(""))


def guidance_length(steps: Column, key: Column) -> Column:
    """Words of the steps (action, observation) as one JSON list, its separators a comma or colon and a blank; of the key
    where there are no steps. White space in a value is escaped but for blanks, so it parts no words."""
    value = lambda v: F.coalesce(F.concat(F.lit('"'), F.regexp_replace(v, r"[\s&&[^ ]]|[\x1c-\x1f\x85\p{Z}&&[^ ]]", "n"), F.lit('"')), F.lit("null"))
    listed = F.transform(steps, lambda s: F.concat(F.lit('{"action": '), value(s["action"]), F.lit(', "observation": '), value(s["observation"]), F.lit("}")))
    words = lambda text: F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    return F.when(F.coalesce(F.size(steps), F.lit(0)) > 0, words(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")))).otherwise(F.size(tokens(key)))


def step_number(text: Column) -> Column:
    """The number after the step's label, null where there is none."""
    after = F.ltrim(F.substring(text, F.instr(text, F.lit(STEP)) + len(STEP), F.length(text)))
    return F.when(F.instr(text, F.lit(STEP)) > 0, F.nullif(F.regexp_extract(after, r"^\d+", 0), F.lit("")).try_cast("int"))


def decomposed(query: Column) -> list[Column]:
    """goal, state, context, progress and step of a full key; missing parts are '' and a missing step null."""
    following = {"goal": ("state",), "state": ("context", "progress"), "context": ("progress",), "progress": ()}
    return [*[_between(query, label, following[label]).alias(label) for label in LABELS], step_number(query).alias("step")]


def sanitised(kind: Column) -> Column:
    """Every character but letters, digits and '_' becomes '_', ends lose '_', nothing left is 'unknown'."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(kind, r"[^\p{L}\p{N}_]", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def tagged_scalar(text: Column) -> tuple[Column, Column, Column]:
    """A scalar string as a whole number, as a number, or else as text: one of the three is set, none for ''."""
    own = F.nullif(F.trim(text), F.lit(""))
    number = own.try_cast("double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("long"))
    return whole, F.when(whole.isNull(), number), F.when(number.isNull(), own)


def components(goal: Column, state: Column, context: Column, progress: Column) -> dict[str, Column]:
    """The trimmed parts of a key, and the whole key as ``full``; null parts are ''."""
    parts = [F.trim(F.coalesce(c, F.lit(""))) for c in (goal, state, context, progress)]
    return {"full": full_key(*parts), **dict(zip(LABELS, parts))}


def raw_key(stored: Column, parts: dict[str, Column]) -> Column:
    """The stored key if it is not blank, else the whole key of ``parts``, null where all of them are empty."""
    some = F.concat(*[parts[label] for label in LABELS]) != ""
    return F.coalesce(F.nullif(F.trim(stored), F.lit("")), F.when(some, parts["full"]))


def document_id(stored: Column, dataset: str, key: Column) -> Column:
    """The stored id if it is not empty, else the data set's name and the key's digest; null without a key."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.concat(F.lit(f"{dataset}_"), F.md5(key)))


def entry_id(run_key: Column, *parts: Column) -> Column:
    """The run's key, else its parts between bars (null ones empty); null where all parts are null."""
    some = ~F.coalesce(*[p.cast("string") for p in parts]).isNull()
    return F.coalesce(F.nullif(run_key, F.lit("")), F.when(some, F.concat_ws("|||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def variation_id(path: Column, root: str) -> Column:
    """A digest of the path from ``root`` on, or of the whole path."""
    at = F.instr(path, F.lit(root))
    return F.concat(F.lit("variation_id_"), F.md5(F.when(at > 0, F.substring(path, at, F.length(path))).otherwise(path)))


def split_tag(path: Column) -> Column:
    """seen or unseen by the path's folder, else by its text ('unseen' holds 'seen'), else other."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.when(F.contains(low, F.lit("/valid_seen/")), "seen").when(F.contains(low, F.lit("/valid_unseen/")), "unseen").when(F.contains(low, F.lit("unseen")), "unseen").when(F.contains(low, F.lit("seen")), "seen").otherwise("other")


def step_limit(given: Column, override: Column) -> Column:
    """A whole number replaces the limit; "N_given" multiplies it and drops the fraction; anything else leaves it."""
    times = F.nullif(F.regexp_extract(override, r"^([0-9.]+)_given$", 1), F.lit("")).try_cast("double")
    return F.coalesce(override.try_cast("int").cast("long"), F.floor(given * times).cast("long"), given.cast("long"))
