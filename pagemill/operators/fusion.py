"""Fusion of a page's own blocks with the candidates of parsers: matches, clusters, votes, labels, order."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import LABEL_SIMILARITY, MATCH_CONTAINMENT, MATCH_IOU, TEXT_OVERLAP
from .walk import walk

#: The kind of region of each label; others are text.
KINDS = {"FOOTNOTE": "FOOTNOTE", "FIGURE": "FIGURE", "TABLE": "TABLE", "FORMULA": "FORMULA", "HEADER": "HEADER", "FOOTER": "FOOTER"}
STRUCTURED = ("TABLE", "FORMULA")
# A draft's score by evidence and best weight, and what agreement adds.
BASE, EACH, BEST, CAP, AGREEMENT, ALIKE = 0.7, 0.1, 0.2, 0.95, 0.15, 0.9
#: Weights of a provider's vote by its rank for the label's capability.
RANK_WEIGHTS, UNLISTED = (1.5, 1.2, 1.0), 0.8
LABEL_CAPABILITY, OTHER_CAPABILITY = {"TABLE": "table.structure", "FORMULA": "formula.detection"}, "layout.region"

_WORD = re.compile(r"\w+")


def kind_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.element_at(table, label), F.lit("TEXT"))


def normalised(candidates: DataFrame, pages: DataFrame, label: Column) -> DataFrame:
    """Regions, tables and formulas on known pages with an area: candidate, page, type, x, y, w, h, native, provider, confidence and the texts preview, unicode, raw, latex; label normalises a native one."""
    rows = candidates.where("type IN ('REGION', 'TABLE_STRUCTURE', 'FORMULA') AND w > 0 AND h > 0").join(pages.select("page").distinct(), "page", "left_semi")
    named = F.when(F.col("type") == "REGION", label).when(F.col("type") == "FORMULA", "FORMULA").otherwise("TABLE")
    text = F.when(F.col("type") == "REGION", F.coalesce("preview", F.lit(""))).when(F.col("type") == "FORMULA", F.coalesce(F.nullif("unicode", F.lit("")), F.nullif("raw", F.lit("")), F.nullif("latex", F.lit("")), F.lit(""))).otherwise("")
    return rows.select("candidate", "page", "x", "y", "w", "h", named.alias("label"), "provider", "confidence", text.alias("text"))


def rank(capability: Column, provider: Column, registry: dict[str, dict[str, str]]) -> Column:
    """0 to 2 for the primary, challenger and fallback of a capability, 3 for others; an empty slot moves nobody up."""
    out = F.lit(3)
    for name, slots in registry.items():
        for i, slot in enumerate(("fallback", "challenger", "primary")):
            if slots.get(slot):
                out = F.when((capability == name) & (provider == slots[slot]), 2 - i).otherwise(out)
    return out


def weight(label: Column, provider: Column, registry: dict[str, dict[str, str]]) -> Column:
    capability = F.lit(OTHER_CAPABILITY)
    for name, own in LABEL_CAPABILITY.items():
        capability = F.when(label == name, own).otherwise(capability)
    weights = F.array(*[F.lit(w) for w in (*RANK_WEIGHTS, UNLISTED)])
    return F.element_at(weights, rank(capability, provider, registry) + 1)


def processing_order(candidates: DataFrame) -> DataFrame:
    """position in each page: structured ones first, then by confidence, then by id."""
    first = F.when(F.col("label").isin(*STRUCTURED), 0).otherwise(1)
    w = Window.partitionBy("page").orderBy(first, F.desc("confidence"), "candidate")
    return candidates.withColumn("position", F.row_number().over(w).cast("long"))


def final_order(regions: DataFrame) -> DataFrame:
    """ordinal of each region in its page, by place and text."""
    return regions.withColumn("ordinal", (F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "text", "region")) - 1).cast("long"))


def dominant(labels: Column, otherwise: Column) -> Column:
    """The first of the labels, best first; else what stands for none."""
    return F.coalesce(F.try_element_at(labels, F.lit(1)), otherwise)


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _alike(a: str, b: str) -> float:
    return 1.0 if a == b else LABEL_SIMILARITY.get((a, b), LABEL_SIMILARITY.get((b, a), 0.0))


def match(a: dict, b: dict, any_label: bool) -> float:
    """How well two boxes describe one region: by their overlap, raised by common words, weighed by their labels; 0 for none."""
    alike = 1.0 if any_label else _alike(a["label"], b["label"])
    if alike <= 0:
        return 0.0
    shared = max(min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]), 0.0) * max(min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]), 0.0)
    area, other = a["w"] * a["h"], b["w"] * b["h"]
    iou = shared / (area + other - shared) if area + other > shared else 0.0
    inside = max(shared / area if area > 0 else 0.0, shared / other if other > 0 else 0.0)
    score = max(iou if iou >= MATCH_IOU else 0.0, inside if inside >= MATCH_CONTAINMENT else 0.0)
    if score <= 0:
        return 0.0
    x, y = _words(a["text"]), _words(b["text"])
    if x and y and (common := len(x & y) / min(len(x), len(y))) >= TEXT_OVERLAP:
        score = max(score, 0.5 + 0.5 * common)
    return min(score * alike, 1.0)


class _Draft:
    """A region in the making: its box, lines, label weights, evidence."""

    def __init__(self, row: dict, label: str, confidence: float, own: bool):
        self.box = [row["x"], row["y"], row["x"] + row["w"], row["y"] + row["h"]]
        self.lines = [(row["y"], row["x"], row["text"])] if own else []
        self.objects = [row["item"]] if own else []
        self.labels, self.kind, self.evidence = [(label, confidence)], KINDS.get(label, "TEXT"), []

    def cover(self, row: dict) -> None:
        b = self.box
        self.box = [min(b[0], row["x"]), min(b[1], row["y"]), max(b[2], row["x"] + row["w"]), max(b[3], row["y"] + row["h"])]

    def absorb(self, other: _Draft) -> None:
        b, o = self.box, other.box
        self.box = [min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3])]
        self.lines = sorted(self.lines + other.lines)
        self.objects += other.objects
        self.labels += other.labels

    @property
    def text(self) -> str:
        return " ".join(t for _, _, t in self.lines)

    def seen(self) -> dict:
        b = self.box
        return {"x": b[0], "y": b[1], "w": b[2] - b[0], "h": b[3] - b[1], "label": max(self.labels, key=lambda i: i[1])[0], "text": self.text}


def vote(candidates: list[dict]) -> tuple[str, float]:
    """The label of the greatest weight (of equal ones the later name), and its share."""
    sums: dict[str, float] = {}
    for c in candidates:
        sums[c["label"]] = sums.get(c["label"], 0.0) + c["weight"]
    best = max(sums, key=lambda label: (sums[label], label))
    return best, sums[best] / sum(sums.values()) if sum(sums.values()) > 0 else 0.0


def fused_page(rows: list[dict]) -> Iterator[tuple]:
    """rows: blocks first (own), then candidates in processing order."""
    drafts = [_Draft(r, r["label"], r["confidence"], True) for r in rows if r["own"]]
    found = [r for r in rows if not r["own"]]
    clusters: list[tuple[list[dict], list]] = []  # candidates; the one draft they stand for, if any
    for c in (r for r in found if r["label"] in STRUCTURED):
        near = [d for d in drafts if match(c, d.seen(), True) > 0]
        home = next((k for k in clusters if k[1] and k[1][0] in near or any(match(c, o, True) > 0 for o in k[0])), None)
        if home is None:
            home = ([], [])
            clusters.append(home)
        home[0].append(c)
        for d in near:
            if not home[1]:
                home[1].append(d)
            elif d is not home[1][0] and d in drafts:
                home[1][0].absorb(d)
                drafts.remove(d)
    rects = []
    for members, base in clusters:
        label, share = vote(members)
        if base:
            base[0].labels.append((label, share))
            base[0].kind = KINDS.get(label, "TEXT")
        else:
            base.append(_Draft(members[0], label, share, False))
            drafts.append(base[0])
        for c in members:
            base[0].cover(c)
            base[0].evidence.append(c["item"])
        rects.append(base[0].box)

    matched: dict[int, list[dict]] = {}
    rest: list[dict] = []
    for c in (r for r in found if r["label"] not in STRUCTURED):
        area = c["w"] * c["h"]
        inside = lambda b, c=c: max(min(b[2], c["x"] + c["w"]) - max(b[0], c["x"]), 0.0) * max(min(b[3], c["y"] + c["h"]) - max(b[1], c["y"]), 0.0)
        if any(inside(b) / area >= MATCH_CONTAINMENT for b in rects):
            continue
        scores = [(match(c, d.seen(), False), -i) for i, d in enumerate(drafts)]
        best = max(scores, default=(0.0, 0))
        if best[0] > 0:
            matched.setdefault(-best[1], []).append(c)
        else:
            rest.append(c)
    for i, members in matched.items():
        d = drafts[i]
        label, share = vote(members)
        main = max(d.labels, key=lambda x: x[1])[0]
        d.labels.append((label, share))
        d.kind = KINDS.get(label, "TEXT")
        for c in members:
            d.cover(c)
            d.evidence.append(c["item"])
            if _alike(c["label"], main) >= ALIKE:
                d.labels.append((main, AGREEMENT))
    groups: list[list[dict]] = []
    for c in rest:
        home = next((g for g in groups if any(match(c, o, True) > 0 for o in g)), None)
        if home is None:
            groups.append([c])
        else:
            home.append(c)
    for members in groups:
        label, share = vote(members)
        d = _Draft(members[0], label, share, False)
        for c in members:
            d.cover(c)
            d.evidence.append(c["item"])
        drafts.append(d)

    drafts.sort(key=lambda d: (d.box[1], d.box[0], d.text))
    for n, d in enumerate(drafts):
        labels: dict[str, float] = {}
        for label, w in sorted(((label, round(min(w, 1.0), 4)) for label, w in d.labels), key=lambda x: (-x[1], x[0])):
            labels.setdefault(label, w)
        score = min(CAP, BASE + EACH * len(d.evidence) + BEST * max(w for _, w in d.labels))
        left, top, right, bottom = d.box
        yield rows[0]["page"], n, d.kind, left, top, right - left, bottom - top, round(score, 4), list(labels), d.objects, d.evidence


REGION = "page long, ordinal long, kind string, x double, y double, w double, h double, score double, labels array<string>, objects array<long>, evidence array<long>"


def fuse(blocks: DataFrame, candidates: DataFrame, registry: dict[str, dict[str, str]]) -> DataFrame:
    """Regions of each page. blocks: page, item, x, y, w, h, label, confidence, text; candidates as normalised() gives them.

    Tables and formulas that describe one region are one cluster and take in the blocks they cover; other candidates go to their
    best block; what matches none is a region of its own. Labels are voted by confidence and authority.
    """
    own = blocks.select("page", F.lit(True).alias("own"), F.col("item").cast("long").alias("position"), "item", "x", "y", "w", "h", "label", "confidence", "text", F.lit(0.0).alias("weight"))
    ranked = processing_order(candidates).withColumn("weight", F.col("confidence") * weight(F.col("label"), F.col("provider"), registry))
    theirs = ranked.select("page", F.lit(False).alias("own"), "position", F.col("candidate").alias("item"), "x", "y", "w", "h", "label", "confidence", "text", "weight")
    rows = own.union(theirs).withColumn("turn", F.when(F.col("own"), 0).otherwise(1))
    return walk(rows, ["page"], ["turn", "position"], fused_page, REGION)


def bundle(members: list[tuple[str, str, DataFrame]], schema_versions: list[str]) -> tuple[str, str, DataFrame]:
    """One bundle of (provider, version, candidates): names joined, candidates with the provider and its place; mixed schemas are an error."""
    if not members:
        raise ValueError("no bundles to merge")
    if len(set(schema_versions)) > 1:
        raise ValueError(f"bundles of different schema versions: {sorted(set(schema_versions))}")
    tables = [t.withColumn("provider", F.lit(p)).withColumn("member", F.lit(i).cast("long")) for i, (p, _, t) in enumerate(members)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return f"ensemble:{'+'.join(p for p, _, _ in members)}", "+".join(v for _, v, _ in members), out


def sink_ids(candidates: DataFrame, by: list[str], order: list[str], prefix: str) -> DataFrame:
    """Ids that a provider's sink gives: from its prefix and a counter in the order of emission."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by], F.lit("evidence"), F.concat(F.lit(prefix), n.cast("string")))
    return candidates.withColumn("counter", n.cast("long")).withColumn("evidence_id", F.substring(F.sha2(key, 256), 1, 32))


def linked_evidence(regions: DataFrame, candidates: DataFrame, need_cells: bool = False) -> DataFrame:
    """regions: region, evidence (array of ids); candidates: candidate, position, n_cells. The first candidate that a region's labels name."""
    rows = regions.select("region", F.explode("evidence").alias("candidate")).distinct().join(candidates.where("n_cells > 0") if need_cells else candidates, "candidate")
    return rows.groupBy("region").agg(F.min_by("candidate", "position").alias("candidate"))


#: What a lost capability counts as, and what stands in for it.
CAPABILITY_ISSUES = {
    "layout.region": ("LAYOUT_REGION", "internal geometry blocking"), "table.detection": ("TABLE_RECOVERY", "table line-row fallback"), "table.structure": ("TABLE_RECOVERY", "table line-row fallback"),
    "formula.detection": ("FORMULA_RECOVERY", "raw formula text"), "formula.recognition": ("FORMULA_RECOVERY", "raw formula text"), "scholarly.metadata": ("SECTION_STRUCTURE", "front-matter heuristics"),
    "scholarly.bibliography": ("CITATION_RESOLUTION", "bibliography text heuristics"),
}
MESSAGE_MOST = 500


def truncated(message: Column) -> Column:
    return F.when(F.length(message) <= MESSAGE_MOST, message).otherwise(F.concat(F.left(message, F.lit(MESSAGE_MOST)), F.lit("...")))


def degradation_issues(failures: DataFrame) -> DataFrame:
    """failures: doc, provider, capabilities and substitutes (arrays), error_type, error. One issue each, attributed to the provider."""
    def first(i: int, otherwise: str) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in CAPABILITY_ISSUES.items() for x in (k, v[i])])
        known = F.array_compact(F.transform("capabilities", lambda c: F.element_at(table, c)))
        return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit(otherwise))

    message = F.concat_ws(": ", "error_type", truncated(F.col("error")))
    subs = F.array_join("substitutes", ", ")
    said = F.concat(F.lit("evidence provider '"), "provider", F.lit("' failed for "), F.array_join("capabilities", ", "), F.lit(": "), message, F.when(subs != "", F.concat(F.lit("; substituted by "), subs)).otherwise(""))
    fallback = F.when(subs != "", F.concat(F.lit("provider substitution: "), subs)).otherwise(first(1, "internal baseline"))
    key = F.concat_ws("\x1f", F.col("doc").cast("string"), F.lit("issue"), "provider", F.array_join("capabilities", ","), message)
    return failures.select("doc", first(0, "LAYOUT_REGION").alias("category"), F.lit("ERROR").alias("severity"), F.col("provider").alias("producer"), said.alias("message"), fallback.alias("fallback"), F.substring(F.sha2(key, 256), 1, 32).alias("issue_id"))


def collect(plan: list[tuple[str, tuple[str, ...]]], providers: dict, registry: dict[str, dict[str, str]], spans: DataFrame) -> tuple[dict[str, DataFrame], list[dict]]:
    """Runs each provider (spans -> candidates) of a plan once, in order; one that fails is replaced by the fallback of its capabilities, which is not replaced again.

    A provider is a function over DataFrames; it fails when its plan cannot be made or read, so its schema is asked for here.
    """
    done: dict[str, DataFrame] = {}
    failed: dict[str, Exception] = {}

    def attempt(name: str) -> Exception | None:
        if name not in done and name not in failed:
            try:
                done[name] = providers[name](spans)
                done[name].schema  # noqa: B018
            except Exception as error:  # noqa: BLE001  a provider must not break the document
                done.pop(name, None)
                failed[name] = error
        return failed.get(name)

    lost: list[dict] = []
    row = lambda name, capabilities, subs, error: {"provider": name, "capabilities": list(capabilities), "substitutes": list(subs), "error_type": type(error).__name__, "error": str(error)}
    for name, capabilities in plan:
        error = attempt(name)
        if error is None:
            continue
        subs, more = [], []
        for c in capabilities:
            other = registry.get(c, {}).get("fallback")
            if other is None or other in subs or other in failed:
                continue
            again = attempt(other)
            if again is None:
                subs.append(other)
            else:
                more.append(row(other, capabilities, (), again))
        lost += [row(name, capabilities, subs, error), *more]
    return done, lost
