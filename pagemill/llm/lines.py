"""Line dedup by a log-template tree of fixed depth.

A line's tokens are parsed with a fixed depth: tokens with a digit are variable fields, `<*>`; the number of tokens
and the first DEPTH tokens are the path to a leaf. A leaf holds groups of lines, at first one of all. In a group, the
token that over half of its lines have at a place is fixed there, and other tokens are variable; a line that agrees with the
fixed tokens in at least SIMILAR of its places has the template of these with `<*>` elsewhere. Lines that agree less are dealt
out to further groups by the most frequent of their tokens that at most half of the group have, until none are left;
a line that shares no such token with another, or of whose template no token would be left, is a template of its own.
Groups halve at least with each round, and depend only on their own lines, not on how many others share the leaf.

A template recurs when it is in MIN_DOCS documents or more; of over LONG tokens LONG_DOCS are enough, and short ones
need as many as SHORT_DOCS says. Lines of recurring templates are dropped, but for the first (by doc_id, then line), so that
no content is lost. Lines of nothing but variable fields (rows of numbers) have no template and stay.

In the pipeline (spare=True) documents of which over half the words would go are left whole if they are near copies, for
near-duplicate removal: if their shingles of COPY_WORDS words have a Jaccard similarity of COPY or more to the document
that has the most of their recurring words first. All others lose their recurring lines whatever their share.

Only built-in functions. Lines are cut and hashed once; a line that a third of all documents have is one row where groups
are made, and joins on hot leaves, lines and templates are followed by a write or another exchange, so that Spark can split them.

A null text has no lines and stays null; an empty or blank line stays. Rows that repeat both doc_id and text are one document,
each written out; other texts of a doc_id are further versions of it. Rows without a doc_id neither count nor lose lines. Ties go to
the token further left, and to the smallest doc_id and line, so any partitioning gives the same. Long lines take time in
proportion to their tokens. Other columns are passed on; those that clash with the new ones raise an error that asks for a prefix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stage, table

DEPTH, MIN_DOCS, SIMILAR = 3, 3, 0.7
#: Documents that make a template recurring by its tokens: the shorter, the more. Beyond the last, LONG_DOCS.
SHORT_DOCS, LONG, LONG_DOCS = {1: 80, 2: 40, 3: 20}, 50, 2
#: What the pipeline's near-duplicate stage takes for copies, and the share of words from which that is asked.
COPY_WORDS, COPY, MAX_SHARE = 5, 0.8, 0.5

#: Bits of a filter of leaves: 2 ** FILTER_BITS, 8 MB, whatever the input.
FILTER_BITS = 26

_BLANKS = " \t\x0b\x0c\r"
_BLANK = r"[\x20\x09\x0B-\x0D]+"


def _masked(line: Column) -> Column:
    """Tokens with one space between; those with a digit are variable. Patterns are run only on lines that need them."""
    uneven = F.contains(line, F.lit("  "))
    for blank in "\t\x0b\x0c\r":
        uneven = uneven | F.contains(line, F.lit(blank))
    plain = F.trim(F.when(uneven, F.regexp_replace(line, _BLANK, " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"(?<![^ ])(?=[^ ]*[0-9])[^ ]++", "<*>")).otherwise(plain)


def _n_tokens(masked: Column) -> Column:
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def _least(n_tokens: Column) -> Column:
    """The documents from which on a template of so many tokens recurs."""
    least = F.when(n_tokens > LONG, LONG_DOCS).otherwise(MIN_DOCS)
    for n, docs in SHORT_DOCS.items():
        least = F.when(n_tokens == n, docs).otherwise(least)
    return least


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), line, n_tokens, leaf, own (hash of the masked line) and masked of all lines that are not blank; no leaf if all tokens are variable."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    rows = rows.where(F.ltrim("raw", F.lit(_BLANKS)) != "").select("doc_id", "version", "line", _masked(F.col("raw")).alias("masked"))
    number = F.startswith("masked", F.lit("<*>")) & F.col("masked").rlike(r"^<\*>(?: <\*>)*$")
    leaf = F.when(~number, F.xxhash64(_n_tokens(F.col("masked")), F.substring_index("masked", " ", DEPTH)))
    return rows.select("doc_id", "version", "line", _n_tokens(F.col("masked")).alias("n_tokens"), leaf.alias("leaf"), F.xxhash64("masked").alias("own"), "masked")


def _placed(tokens: Column) -> Column:
    """A hash of each token with its place."""
    return F.transform(tokens, lambda t, i: F.xxhash64(i, t))


def _fitted(open_: DataFrame) -> DataFrame:
    """open_ with template, the hash of the fixed tokens of its group that the line has, or null if it has too few of them."""
    tokens = open_.select("group", "all", "n", F.explode(_placed(F.split("masked", " "))).alias("token"))
    # All lines of a group have as many tokens, so a place is held as often as the group has lines.
    fixed = tokens.groupBy("group", "token").agg(F.sum("n").alias("n"), F.max("all").alias("all")).where(2 * F.col("n") > F.col("all"))
    fixed = fixed.groupBy("group").agg(F.collect_list("token").alias("fixed"))
    joined = open_.join(fixed, "group", "left").withColumn("placed", _placed(F.split("masked", " ")))
    joined = joined.withColumn("same", F.array_intersect("placed", F.coalesce("fixed", F.array().cast("array<long>"))))
    template = F.when(F.size("same") >= SIMILAR * F.size("placed"), _name(F.col("masked"), F.col("same")))
    return joined.withColumn("template", template).drop("fixed", "placed", "same")


def _name(masked: Column, same: Column | None = None) -> Column:
    """The hash of a line's tokens with their places, variable fields left out; of those in `same` alone, if any are."""
    placed = F.transform(F.split(masked, " "), lambda t, i: F.when(t != "<*>", F.xxhash64(i, t)))
    own = F.array_compact(placed)
    both = own if same is None else F.array_intersect(own, same)
    return F.xxhash64(F.when(F.size(both) > 0, both).otherwise(own))


def _near(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows of which the leaf (a hash) may be among leaves: a bitmap of 2 ** FILTER_BITS hashes, which is at most so many bits for any input, spares shuffling most others."""
    at = lambda c: F.shiftrightunsigned(c, 64 - FILTER_BITS)
    bits = leaves.groupBy(F.shiftright(at("leaf"), 15).alias("part")).agg(F.bitmap_construct_agg(at("leaf").bitwiseAND(32767)).alias("bits"))
    joined = rows.withColumn("part", F.shiftright(at("leaf"), 15)).join(F.broadcast(bits), "part")
    byte = F.substring("bits", (F.shiftright(at("leaf").bitwiseAND(32767), 3) + 1).cast("int"), F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), at("leaf").bitwiseAND(7).cast("int"))
    return joined.where(held == 1).drop("part", "bits")


def templates(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """own and template of the lines in leaves that two documents or more share, and the staged tables this reads; lines are dropped. A masked line tells its leaf.

    What a round tells is written by itself, as hashes alone, so that no texts of a round outlive it, however many rounds there are.
    """
    shared = lines.where("leaf IS NOT NULL").groupBy("leaf").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("all")).where("a < b")
    shared = stage(shared.select("leaf", "all"), "shared")
    # Grouped by the line alone: were the leaf among the keys, Spark would count where it joins, and not split hot leaves.
    near = _near(lines.select("leaf", "masked"), shared)
    counted = near.hint("merge").join(shared, "leaf").groupBy("masked").agg(F.max("leaf").alias("leaf"), F.count("*").alias("n"), F.max("all").alias("all"))
    open_ = stage(counted.withColumn("group", F.col("leaf")), "lines")
    drop(lines, shared)
    own = lambda rows, template: rows.select(F.xxhash64("masked").alias("own"), F.xxhash64("leaf", template).alias("template"))
    out = []
    while True:
        # A line that is alone in its group is its template.
        alone = F.col("n") == F.col("all")
        out.append(stage(own(open_.where(alone), _name(F.col("masked"))), "told"))
        fitted = _fitted(open_.where(~alone)).withColumn("own", F.when(F.col("template").isNotNull(), F.xxhash64("masked")))
        named = stage(fitted.select("leaf", "group", F.when(F.col("template").isNull(), F.col("masked")).alias("masked"), "n", "all", "own", "template"), "named")
        drop(open_)
        out.append(stage(named.where("template IS NOT NULL").select("own", F.xxhash64("leaf", "template").alias("template")), "told"))
        rest = named.where("template IS NULL").drop("own", "template")
        if rest.isEmpty():
            drop(named)
            break
        # A token is told by a hash of its group, place and text, and its line by another, so that texts are not repeated for each of their tokens.
        rest = rest.withColumn("own", F.xxhash64("masked"))
        tokens = rest.select("group", "own", "n", "all", F.posexplode(F.split("masked", " ")).alias("place", "token"))
        tokens = tokens.select("own", "n", "all", "place", F.xxhash64("group", "place", "token").alias("token"))
        held = tokens.groupBy("token").agg(F.sum("n").alias("held"), F.count("*").alias("kinds"), F.max("all").alias("most"))
        held = held.where("2 * held <= most AND kinds > 1").select("token", "held")
        by = tokens.select("own", "place", "token").join(held, "token").groupBy("own").agg(F.max_by("token", F.struct("held", -F.col("place"))).alias("group"))
        dealt = stage(rest.select("leaf", "masked", "n", "own").join(by, "own", "left").select("leaf", "masked", "n", "group"), "dealt")
        drop(named)
        # No other line has a token at one of their places: templates of their own.
        out.append(stage(own(dealt.where("group IS NULL"), _name(F.col("masked"))), "told"))
        sizes = dealt.where("group IS NOT NULL").groupBy("group").agg(F.sum("n").alias("all"))
        open_ = stage(dealt.join(sizes, "group"), "open")
        drop(dealt)
    return reduce(DataFrame.union, out), out


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, version, the numbers (from 0) of the lines to drop, their words and the host of most of these words; documents without such lines are left out."""
    lines = stage(_lines(docs), "cut")
    # One row for each different line; lines are told apart by their hash.
    places = stage(lines.where("leaf IS NOT NULL").select("doc_id", "version", "line", "n_tokens", "own"), "places")
    names, old = templates(lines)
    at = stage(places.hint("merge").join(names, "own").select("doc_id", "version", "line", "n_tokens", "template"), "occurrences")
    drop(places, *old)
    by_doc = at.groupBy("template", "doc_id").agg(F.min("line").alias("line"), F.min("n_tokens").alias("n_tokens"))
    by_doc = by_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "line")).alias("first"), F.min("n_tokens").alias("n"))
    # Written by itself, so that Spark can split hot templates where these are joined.
    recurring = stage(by_doc.where(F.col("docs") >= _least(F.col("n"))).select("template", "first"), "recurring")
    out = at.hint("merge").join(recurring, "template").where("doc_id <> first.doc_id OR line <> first.line")
    out = out.select("doc_id", "version", "line", "n_tokens", F.col("first.doc_id").alias("host")).distinct()
    by_host = out.groupBy("doc_id", "version", "host").agg(F.collect_list("line").alias("lines"), F.sum("n_tokens").alias("words"))
    most = F.max(F.struct("words", (-F.col("host")).alias("host")))
    gone = stage(by_host.groupBy("doc_id", "version").agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("lines"), F.sum("words").alias("words"), (-most["host"]).alias("host")), "gone")
    drop(at, recurring)
    return gone


def _shingles(text: str) -> Column:
    """Hashes of the different runs of COPY_WORDS words, or of a shorter text as a whole; A-Z in lower case."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    runs = F.arrays_zip(*(F.slice(words, 1 + i, F.size(words)).alias(f"w{i}") for i in range(COPY_WORDS)))
    return F.array_distinct(F.transform(F.slice(runs, 1, F.greatest(F.size(words) - COPY_WORDS + 1, F.lit(1))), lambda r: F.xxhash64(r)))


def copies(over: DataFrame, docs: DataFrame) -> DataFrame:
    """Of over (doc, version, host) the doc and version of those that are near copies of a text of their host; docs has doc_id, version and text.

    Of docs only the texts that may be among these travel.
    """
    over = over.where("doc <> host")
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("leaf", F.xxhash64("doc_id"))
    mine = _near(keyed, over.select(F.xxhash64("doc").alias("leaf"))).select(F.col("doc_id").alias("doc"), "version", "text")
    other = _near(keyed, over.select(F.xxhash64("host").alias("leaf"))).select(F.col("doc_id").alias("host"), F.col("text").alias("host_text"))
    pairs = over.join(mine, ["doc", "version"]).join(other, "host").select("doc", "version", _shingles("text").alias("x"), _shingles("host_text").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.where(shared >= COPY * (F.size("x") + F.size("y") - shared)).select("doc", "version").distinct()


def clean(docs: DataFrame, text: str = "text", prefix: str = "", spare: bool = False) -> DataFrame:
    """docs with the recurring lines taken out of its text, and the columns n_lines and n_dropped; spare: near copies stay whole."""
    if clash := {prefix + "n_lines", prefix + "n_dropped"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    names = {}
    for c in ("doc", "version", "lines", "words", "host", "copy", "copy_version"):
        names[c] = f"__{c}"
        while names[c] in docs.columns:
            names[c] += "_"
    col = lambda c: F.col(names[c])
    t, key = F.col(f"`{text}`"), F.col("`doc_id`").cast("long")
    version = F.xxhash64(t)
    pairs = docs.select(key.alias("doc_id"), t.alias("text"), version.alias("version"))
    gone = dropped(pairs)
    # Neither side is bounded: no broadcast, at any size.
    joined = docs.hint("merge").join(gone.select(F.col("doc_id").alias(names["doc"]), *(F.col(c).alias(names[c]) for c in gone.columns[1:])), (key == col("doc")) & (version == col("version")), "left")
    if spare:
        # Only of documents that would lose over half their words the texts are looked at again; their keys are found without any text.
        words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        able = _near(pairs.where("doc_id IS NOT NULL").withColumn("leaf", F.xxhash64("doc_id")), gone.select(F.xxhash64("doc_id").alias("leaf")))
        sized = able.select(F.col("doc_id").alias("doc"), "version", words.alias("all")).dropDuplicates(["doc", "version"])
        lost = gone.select(F.col("doc_id").alias("doc"), "version", F.col("words").alias("lost"), "host")
        over = stage(lost.hint("merge").join(sized, ["doc", "version"]).where(F.col("lost") > MAX_SHARE * F.col("all")).select("doc", "version", "host"), "over")
        found = stage(copies(over, pairs), "copies").select(F.col("doc").alias(names["copy"]), F.col("version").alias(names["copy_version"]))
        drop(over)
        # By the same expressions as before, so that texts are not dealt out again.
        joined = joined.hint("merge").join(found, (key == col("copy")) & (version == col("copy_version")), "left")
    lost = F.when(col("copy").isNull(), col("lines")) if spare else col("lines")
    # A flag for each line up to the last that goes, so that long texts take time in proportion.
    goes = F.flatten(F.transform(lost, lambda x, i: F.concat(F.array_repeat(F.lit(False), F.when(i > 0, x - F.get(lost, i - 1) - 1).otherwise(x)), F.array(F.lit(True)))))
    flagged = F.arrays_zip(F.split(t, "\n").alias("line"), goes.alias("goes"))
    kept = F.array_join(F.transform(F.filter(flagged, lambda z: ~F.coalesce(z["goes"], F.lit(False))), lambda z: z["line"]), "\n")
    new = F.when(lost.isNotNull(), kept).otherwise(t)
    columns = [(new if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    # Line feeds and one more.
    n_lines = F.when(t.isNull(), F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select(*columns, n_lines.alias(f"{prefix}n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(f"{prefix}n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


def _round_sql(k: int) -> str:
    """One round of groups: named{k} are lines with a template, o{k + 1} the lines of the next round's groups."""
    return rf"""
, t{k} AS MATERIALIZED (
  SELECT grp, place, tok, sum(n) AS c, max(total) AS total FROM (SELECT grp, n, total, unnest(toks) AS tok, generate_subscripts(toks, 1) AS place FROM o{k}) GROUP BY ALL
), s{k} AS MATERIALIZED (
  SELECT grp, list(tok ORDER BY place) AS fix FROM (SELECT grp, place, max(CASE WHEN 2 * c > total THEN tok END) AS tok FROM t{k} GROUP BY grp, place) GROUP BY grp
), f{k} AS MATERIALIZED (
  SELECT leaf, grp, masked, toks, n, total, CASE WHEN len(list_filter(own, lambda x: x IS NOT NULL)) >= {SIMILAR} * len(own) THEN
         CASE WHEN len(list_filter(own, lambda x: x IS NOT NULL AND x <> '<*>')) > 0 THEN array_to_string([coalesce(x, '<*>') FOR x IN own], ' ') ELSE masked END END AS template
  FROM (SELECT o.*, [CASE WHEN z[1] = z[2] THEN z[1] END FOR z IN list_zip(toks, fix)] AS own FROM o{k} o JOIN s{k} USING (grp))
), p{k} AS MATERIALIZED (
  SELECT grp, masked, n, total, unnest(toks) AS tok, generate_subscripts(toks, 1) AS place FROM f{k} WHERE template IS NULL
), h{k} AS MATERIALIZED (
  SELECT grp, place, tok, sum(n) AS held FROM p{k} GROUP BY ALL HAVING 2 * sum(n) <= max(total) AND count(*) > 1
), b{k} AS MATERIALIZED (
  SELECT grp, masked, arg_max(place || ' ' || tok, {{'h': held, 'p': -place}}) AS tag FROM p{k} JOIN h{k} USING (grp, place, tok) GROUP BY grp, masked
), o{k + 1} AS MATERIALIZED (
  SELECT leaf, f.grp || '/' || tag AS grp, masked, toks, n, sum(n) OVER (PARTITION BY f.grp || '/' || tag) AS total FROM f{k} f JOIN b{k} USING (grp, masked)
), named{k} AS (
  SELECT leaf, masked, coalesce(template, masked) AS template FROM f{k} f WHERE template IS NOT NULL OR NOT EXISTS (SELECT 1 FROM b{k} b WHERE b.grp = f.grp AND b.masked = f.masked)
)"""


#: Rounds written out for SQL; groups halve, so these do for leaves of 2 ** SQL_ROUNDS lines.
SQL_ROUNDS = 14

ORACLE_SQL = rf"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM (SELECT DISTINCT doc_id, text FROM documents)
), split AS (
  SELECT doc_id, text, line, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN
         regexp_extract_all(raw, '[^\x20\x09\x0B-\x0D]+')] AS toks FROM raw
), lines AS MATERIALIZED (
  SELECT *, len(toks) AS n, array_to_string(toks, ' ') AS masked, len(toks) || ':' || array_to_string(toks[1:{DEPTH}], ' ') AS leaf
  FROM split WHERE len(list_filter(toks, lambda t: t <> '<*>')) > 0
), o0 AS MATERIALIZED (
  SELECT leaf, leaf AS grp, masked, any_value(toks) AS toks, count(*) AS n, sum(count(*)) OVER (PARTITION BY leaf) AS total FROM lines
  WHERE leaf IN (SELECT leaf FROM lines GROUP BY leaf HAVING min(doc_id) < max(doc_id)) GROUP BY leaf, masked
){"".join(_round_sql(k) for k in range(SQL_ROUNDS))}
, named AS ({" UNION ALL ".join(f"SELECT * FROM named{k}" for k in range(SQL_ROUNDS))}
), occurrences AS (SELECT l.doc_id, l.text, l.line, l.n, n.leaf, n.template FROM lines l JOIN named n USING (leaf, masked)
), recurring AS (
  SELECT leaf, template, min({{'d': doc_id, 'l': line}}) AS first FROM occurrences GROUP BY leaf, template
  HAVING count(DISTINCT doc_id) >= CASE max(n) {" ".join(f"WHEN {n} THEN {docs}" for n, docs in SHORT_DOCS.items())} ELSE CASE WHEN max(n) > {LONG} THEN {LONG_DOCS} ELSE {MIN_DOCS} END END
), gone AS (
  SELECT doc_id, text, list(line) AS lines FROM occurrences JOIN recurring USING (leaf, template)
  WHERE doc_id <> first.d OR line <> first.l GROUP BY doc_id, text
), marked AS (SELECT d.doc_id, d.text, g.lines FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.text = g.text
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(lines), 0)::BIGINT AS n_dropped,
       sha256(coalesce(CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(lines, i - 1)), chr(10)) END, '')) AS clean_sha256
FROM marked
"""
