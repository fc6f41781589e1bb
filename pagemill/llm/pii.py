"""Personal data: rules with checks, and boosted trees over high-recall candidates.

Everything that touches documents is built-in column functions, row by row; nothing is shuffled.
Matches of a pattern and the text between them (split and regexp_extract_all use the same matches) give the
offsets, in code points, and the context of each candidate.

Base spans come from fixed patterns with checks (parts of an address, Luhn, number of digits); they always stay.
Besides, generators with high recall propose spans, which may overlap; gradient-boosted trees over features of
format and context, written out as CASE expressions, score each; it is selected if it reaches the threshold that
was calibrated for its kind and overlaps neither a base span nor an earlier-listed selected one.
The trees are fitted on TRAINING labelled candidates drawn from templates (the tables hold no labels of personal
data), and the thresholds on as many others, for a precision of PRECISION.

A null or empty text has no spans; redaction leaves null null. Repeated rows are treated each for itself.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TRAINING, PRECISION, TREES, DEPTH, RATE = 2000, 0.995, 16, 3, 0.4

# Possessive forms of the base patterns: same matches, without backtracking over long runs. A match
# begins where the one before ended (\G) or where no character of its first run stands before it.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Generators of the method, by kind; of overlapping selected spans the kind that comes first stays.
GENERATORS = {
    "national_id": r"(?<![0-9A-Za-z])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){3,7}+(?:[ ]?[0-9A-Z]{1,3})?",
    "masked_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++[ ]?(?:\(at\)|\[at\]|@)[ ]?[A-Za-z0-9-]++[ ]?(?:\(dot\)|\[dot\]|\.)[ ]?[A-Za-z]{2,}+",
    "secret": r"(?i)(?:password|passwd|secret|api_?key|token)[ ]?[=:][ ]?[!-~]{6,}+",
    "local_phone": r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ ./-]{1,2}[0-9]{2,6}){1,4}+",
}
GENERATOR_HINT = {"local_phone": r"[0-9]\)?[ ./-]{1,2}[0-9]", "national_id": r"[0-9][- ][0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "masked_email": r"(?:\(at\)|\[at\]|@)", "secret": r"[=:]"}
ORDER = [*BASE, *GENERATORS]

#: Words before a candidate that speak for it, and such that speak against.
FOR = r"(?i)(?:phone|tel|mobile|call|fax|ssn|social|security|iban|account|konto|contact|mail|write|login)[^0-9A-Za-z]*(?:[a-z]{1,8}[^0-9A-Za-z]+)?$"
AGAINST = r"(?i)(?:version|isbn|issn|order|page|pages|chapter|section|date|invoice|article|no|nr|vol|lines?)[^0-9A-Za-z]*$"


def matches(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, end, match, before, after>> of all matches, left to right."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"
    both = F.arrays_zip(pieces.alias("p"), found.alias("m"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("a"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), F.right(x["p"], F.lit(32)).alias("before"), F.left(x["a"], F.lit(1)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    all_of = F.aggregate(F.filter(both, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(hint), all_of).otherwise(F.array().cast(kind))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


# Features: name -> the same measure as a column function and in Python, for training.
def _count(text: str, of: str) -> int:
    return sum(c in of for c in text)


_DIGITS = "0123456789"
FEATURES = {
    "length": lambda c: F.length(c["match"]),
    "digits": lambda c: F.length(F.regexp_replace(c["match"], "[^0-9]", "")),
    "letters": lambda c: F.length(F.regexp_replace(c["match"], "[^A-Za-z]", "")),
    "groups": lambda c: F.size(F.split(c["match"], "[^0-9A-Za-z]+")),
    "dots": lambda c: F.length(F.regexp_replace(c["match"], r"[^.]", "")),
    "slashes": lambda c: F.length(F.regexp_replace(c["match"], "[^/]", "")),
    "dashes": lambda c: F.length(F.regexp_replace(c["match"], "[^-]", "")),
    "bracket": lambda c: c["match"].rlike(r"[(\[]").cast("int"),
    "year": lambda c: c["match"].rlike(r"(?:^|[^0-9])(?:19|20)[0-9][0-9](?:[^0-9]|$)").cast("int"),
    "mixed": lambda c: c["match"].rlike(r"[0-9][A-Za-z]|[A-Za-z][0-9]").cast("int"),
    "spoken": lambda c: c["match"].rlike(r"(?:\(at\)|\[at\])").cast("int"),
    "for": lambda c: c["before"].rlike(FOR).cast("int"),
    "against": lambda c: c["before"].rlike(AGAINST).cast("int"),
    "goes_on": lambda c: c["after"].rlike("[0-9A-Za-z]").cast("int"),
}


def _featured(match: str, before: str, after: str) -> list[float]:
    import re

    return [
        len(match),
        _count(match, _DIGITS),
        sum(c.isascii() and c.isalpha() for c in match),
        len(re.split("[^0-9A-Za-z]+", match)),
        match.count("."),
        match.count("/"),
        match.count("-"),
        bool(re.search(r"[(\[]", match)),
        bool(re.search(r"(?:^|[^0-9])(?:19|20)[0-9][0-9](?:[^0-9]|$)", match)),
        bool(re.search(r"[0-9][A-Za-z]|[A-Za-z][0-9]", match)),
        bool(re.search(r"(?:\(at\)|\[at\])", match)),
        bool(re.search(FOR, before)),
        bool(re.search(AGAINST, before)),
        bool(re.search("[0-9A-Za-z]", after)),
    ]


def _labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, kind (place in GENERATORS) and label of n candidates drawn from templates."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices(_DIGITS, k=k))
    w = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    good, bad, plain = ["phone: ", "call me at ", "tel. ", "SSN ", "account ", "write to ", "IBAN: "], ["version ", "order no. ", "pages ", "date: ", "ISBN ", "section "], ["", "and ", "the ", ", "]
    kinds = list(GENERATORS)
    year = lambda: f"{rng.choice(['19', '20'])}{d(2)}"
    yes = {
        "local_phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(3)} {d(4)}"]),
        "national_id": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "iban": lambda: rng.choice([f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"DE{d(20)}", f"GB{d(2)}WEST{d(14)}"]),
        "masked_email": lambda: f"{w()}.{w()}{rng.choice([' (at) ', '[at]', ' [at] '])}{w()}{rng.choice([' (dot) ', '.', '[dot]'])}{rng.choice(['com', 'org', 'de'])}",
        "secret": lambda: f"{rng.choice(['password', 'token', 'api_key', 'secret'])}={''.join(rng.choices('0123456789abcdef', k=rng.randrange(8, 40)))}",
    }
    no = {
        "local_phone": lambda: rng.choice([f"{year()}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{year()}", f"{d(2)}.{d(2)}.{d(2)}", f"{d(2)} {d(3)} {d(3)}", f"{d(3)}.{d(2)}.{d(3)}.{d(2)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(2)}", f"{d(3)} {d(2)} {d(3)}"]),
        "national_id": lambda: f"{d(3)} {d(2)} {d(4)}",
        "iban": lambda: f"{rng.choice('ABCXYZ')}{rng.choice('QWXZ')}{d(2)}{'ABCDEFGHIJKL' if rng.random() < 0.5 else d(4) + 'ABCD' * 2}",
        "masked_email": lambda: f"{w()}{rng.choice(['@ ', ' @', ' @ '])}{w()}. {w()}",
        "secret": lambda: f"{rng.choice(['password', 'token', 'secret'])}: {w()}{rng.choice(['', ',', '.'])}",
    }
    x, kind, y = [], [], []
    for _ in range(n):
        k, label = rng.randrange(len(kinds)), rng.random() < 0.5
        before = rng.choice(good * 2 + plain * 3 if label else bad * 3 + plain * 3)
        after = rng.choice([" ", ".", ",", "\n", ""]) if label or rng.random() < 0.6 else rng.choice("a7")
        x.append(_featured((yes if label else no)[kinds[k]](), before, after))
        kind.append(k)
        y.append(label)
    return np.array(x, float), np.array(kind), np.array(y, float)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree as (feature, threshold, left, right) or a leaf's value; left is where feature <= threshold."""
    value = RATE * float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return value
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12), method="lower")):
            left = x[:, f] <= t
            if left.all() or not left.any():
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[~left].sum() ** 2 / (h[~left].sum() + 1.0) - whole
            if gain > best[0]:
                best = (gain, f, float(t))
    if best[1] is None:
        return value
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1)


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, left, right = tree
    return np.where(x[:, f] <= t, _predict(left, x), _predict(right, x))


@lru_cache(1)
def model() -> tuple[list, dict[str, float]]:
    """Trees, and the threshold of each kind: the lowest score from which held-out candidates reach PRECISION."""
    x, kind, y = _labelled(TRAINING, 11)
    x = np.c_[x, kind]
    trees, score = [], np.zeros(len(x))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, y - p, p * (1 - p), DEPTH))
        score += _predict(trees[-1], x)
    x, kind, y = _labelled(TRAINING, 12)
    score = sum(_predict(t, np.c_[x, kind]) for t in trees)
    thresholds = {}
    for k, name in enumerate(GENERATORS):
        s, label = score[kind == k], y[kind == k]
        order = np.argsort(-s, kind="stable")
        precision = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(precision >= PRECISION)
        thresholds[name] = max(0.0, float(s[order][enough[-1]])) if len(enough) else float("inf")
    return trees, thresholds


def _as_sql(tree, names: list[str]) -> str:
    if isinstance(tree, float):
        return repr(tree) + "D"
    f, t, left, right = tree
    return f"CASE WHEN {names[f]} <= {t!r}D THEN {_as_sql(left, names)} ELSE {_as_sql(right, names)} END"


def _features(found: Column) -> Column:
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), *(f(c).cast("double").alias(n) for n, f in FEATURES.items())))


def _selected(column: str, kind: str) -> Column:
    """Of candidates with features, the spans whose score reaches the kind's threshold."""
    trees, thresholds = model()
    names = [*(f"c.`{n}`" for n in FEATURES), f"{list(GENERATORS).index(kind)}D"]
    score = " + ".join(_as_sql(t, names) for t in trees)
    return F.expr(f"transform(filter({column}, c -> {score} >= {thresholds[kind]!r}D), c -> struct(c.start AS start, c.end AS end))")


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _checked(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], HINT[kind]), lambda c: _valid(kind, c["match"]))


def find(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with base and spans: array<struct<kind, start, end>>, by kind as in ORDER, then start."""
    if clash := {prefix + "base", prefix + "spans"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns]
    base = F.concat(*(_named(_checked(t, k), k) for k in BASE)).alias(f"{prefix}base")
    found = docs.select(*own, base, *(_features(matches(t, GENERATORS[k], GENERATOR_HINT[k])).alias(f"__{k}") for k in GENERATORS))
    found = found.withColumn("__all", F.col(f"{prefix}base"))
    for kind in GENERATORS:
        free = F.filter(_selected(f"__{kind}", kind), lambda s: ~F.exists("__all", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        found = found.withColumn("__all", F.concat("__all", _named(free, kind)))
    return found.select(*own, f"{prefix}base", F.col("__all").alias(f"{prefix}spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with [KIND] in place of each span; columns as they came. Of overlapping spans, what the first leaves is taken out without a mark."""
    found = find(docs, text, "__pii_")
    t = F.col(f"`{text}`")
    ordered = F.array_sort(F.transform("__pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # Ends of what has been taken out so far: they only grow.
    kind = "array<struct<from:bigint,until:bigint,mark:string>>"

    def step(acc: Column, s: Column) -> Column:
        cut = F.struct(acc["at"].alias("from"), F.greatest(acc["at"], s["start"]).alias("until"), F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("").alias("mark"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(cut)).alias("out"))

    cuts = F.aggregate(ordered, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out")), step)
    found = found.withColumn("__pii_cuts", F.when(F.size("__pii_spans") > 0, cuts))
    kept = F.array_join(F.transform("__pii_cuts.out", lambda c: F.concat(F.substr(t, (c["from"] + 1).cast("int"), (c["until"] - c["from"]).cast("int")), c["mark"])), "")
    clean = F.when(F.size("__pii_spans") > 0, F.concat(kept, F.substr(t, (F.col("__pii_cuts.at") + 1).cast("int")))).otherwise(t)
    return found.select(*((clean if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(_of_kind(k) for k in BASE),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
