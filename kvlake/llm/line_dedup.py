"""Line de-duplication by a deletion-neighbourhood join.

A line's words are its trimmed, lower-cased text cut at single spaces. Two lines of ``min_words`` words or more
are near-equal if one word is replaced, put in or left out between them (word edit distance of at most 1). Of the
lines in order of (doc_id, line number), a line goes if an earlier line is equal or near-equal to it. Shorter lines
stay, or with ``short`` (as in the pipeline) go if an earlier line is equal: then every line that isn't blank is
compared, whatever its length, and ``min_words`` bounds the near-equal lines alone. A text of which no line is left
becomes empty; the pipeline drops such documents.

The neighbourhood of a line is the line itself and each line with one word left out. Its keys are XORs of
position-dependent word hashes, so a line of n words makes its n + 1 keys in O(n). Lines that share the key of
the same left-out position differ in that word alone; a line's own key shared with another's deletion means
that the other has one word more. Both cases need no pairs: the earliest line of a key settles all others, and
each settled line is checked word by word against the earlier line that settles it.

Before that, two exact filters drop lines that can't have a partner. With at most one edit, two lines agree in
their first or in their last ``min_words // 2`` words; of the lines that share one of these with another, only those
that share a first or last half (in words) with one of them make keys.

Defined results: null or empty texts have no lines to compare and stay as they are. A line is named by its document's
id, a hash of the whole text and its number, and comes in that order: rows that repeat a doc_id with different texts
are documents of their own, and rows that repeat doc_id and text count as one. A null doc_id comes first in order;
extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlake.llm.common import fresh, table, written

MIN_WORDS = 10


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit("text"), text)


def ends(norm: Column, sign: int, words: int) -> Column:
    """The first (``sign`` 1) or last (-1) words of a line, all of it if there are no more."""
    return F.call_function("substring_index", norm, F.lit(" "), F.lit(sign * words))


def long_enough(norm: Column, min_words: int) -> Column:
    return F.octet_length(ends(norm, 1, min_words - 1)) < F.octet_length(norm) if min_words > 1 else F.lit(True)


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_words: int, short: bool = False) -> DataFrame:
    """at (id, text hash, number), norm, long: the lines that are long enough to be compared, or with ``short`` all that aren't blank."""
    x = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("text"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line"))
    x = x.select(F.struct("id", "text", "no").alias("at"), F.lower(F.trim("line")).alias("norm"))
    x = x.withColumn("long", long_enough(F.col("norm"), min_words))
    return x.where(F.col("long") | F.col("norm").rlike(r"(?U)\S") if short else F.col("long"))


def picked(text: Column, numbers: Column, make) -> Column:
    """make(line, number) of the numbered lines of a text, as an array. The text is split once: as a lambda's argument it isn't split again for each line."""
    lines = F.array(F.split(text, "\n"))
    return F.get(F.transform(lines, lambda parts: F.transform(numbers, lambda no: make(F.get(parts, no), no))), F.lit(0))


def half_keys(words: Column) -> Column:
    """Hashes of the first and last half for the word counts n and n - 1, of which a partner shares one."""
    keys, n = [], F.size(words)
    for less in (0, 1):
        h = F.floor((n - less) / 2).cast("int")
        keys += [F.xxhash64(F.lit(side), n - less, F.slice(words, start, h)) for side, start in ((0, F.lit(1)), (1, n - h + 1))]
    return F.array(*keys)


def sharing(lines: DataFrame, keys: Column) -> DataFrame:
    """at: those of the lines that share one of their keys with another."""
    keyed = lines.select("at", F.explode(F.array_distinct(keys)).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    return keyed.join(shared, "key", "left_semi").select("at").distinct()


def at_most_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one word replaced, put in or left out, or are equal."""
    n, m = F.size(a), F.size(b)
    differs = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), F.lit(True))
    alike = lambda x, y: F.when(differs(x, y) == 0, F.least(n, m)).otherwise(differs(x, y) - 1)
    return (F.abs(n - m) <= 1) & (alike(a, b) + alike(F.reverse(a), F.reverse(b)) >= F.greatest(n, m) - 1)


def near_removals(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """at, by: each distinct line with an earlier one that is one edit away, and the earliest such line found."""
    # the texts of lines that share an end with another line, and of these the ones that share a half
    alive = sharing(distinct.where("head is not null"), F.array("head", "tail")).groupBy(F.col("at.id").alias("alive_id"), F.col("at.text").alias("alive_text")).agg(F.collect_list("at.no").alias("nos"))
    texts = docs.withColumn("text_hash", text_hash(F.col(text_col))).join(alive, F.col(id_col).eqNullSafe(F.col("alive_id")) & (F.col("text_hash") == F.col("alive_text")))
    own = picked(F.col(text_col), F.col("nos"), lambda line, no: F.struct(F.struct(F.col("alive_id").alias("id"), F.col("alive_text").alias("text"), no.alias("no")).alias("at"), F.lower(F.trim(line)).alias("norm")))
    texts = written(texts.select(F.inline(own)), "lines-alive")
    halves = sharing(texts.select("at", half_keys(F.split("norm", " ")).alias("halves")), F.col("halves"))
    texts = written(texts.join(halves, "at").dropDuplicates(["at"]).select("at", F.split("norm", " ").alias("words")), "lines-halves")

    # the key of each deletion (gap: the word left out) and of the whole line (gap -1), from running XORs over the line's
    # words; a line lies in one partition from here on, so the windows deal nothing anew
    w = texts.repartition("at").select("at", F.posexplode("words").alias("gap", "w")).select("at", "gap", F.xxhash64("w").alias("w"))
    line = Window.partitionBy("at")
    run = line.orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    for s in ("0", "1"):
        w = w.withColumn("a" + s, F.xxhash64(F.lit(int(s)), "w", "gap")).withColumn("b" + s, F.xxhash64(F.lit(int(s)), "w", F.col("gap") - 1))
    for s in ("0", "1"):
        w = w.withColumn("own" + s, F.bit_xor("a" + s).over(run)).withColumn("moved" + s, F.bit_xor("b" + s).over(run))
    for s in ("0", "1"):
        w = w.withColumn("all" + s, F.bit_xor("b" + s).over(line))
    w = w.withColumn("n", F.count("*").over(line))
    v = lambda s: F.col("own" + s).bitwiseXOR(F.col("a" + s)).bitwiseXOR(F.col("all" + s)).bitwiseXOR(F.col("moved" + s)).alias("v" + s)
    whole = F.when(F.col("gap") + 1 == F.col("n"), F.array(F.struct(F.col("own0").alias("v0"), F.col("own1").alias("v1"), F.lit(-1).alias("gap"))))
    keys = w.select("at", F.explode(F.concat(F.array(F.struct(v("0"), v("1"), "gap")), F.coalesce(whole, F.array().cast("array<struct<v0:bigint,v1:bigint,gap:int>>")))).alias("x")).select("at", "x.*")
    keys = written(keys, "lines-keys", plain=True)

    # of each key that two lines share, the earliest line settles the others
    several = keys.groupBy("v0", "v1").count().where("count > 1").select("v0", "v1")
    keys = written(keys.join(several, ["v0", "v1"], "left_semi"), "lines-meeting", plain=True)
    groups = keys.groupBy("v0", "v1", "gap").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    meets = groups.groupBy("v0", "v1").agg(F.min(F.when(F.col("gap") < 0, F.col("first"))).alias("own"), F.min(F.when(F.col("gap") >= 0, F.col("first"))).alias("cut"))
    on = groups.join(meets, ["v0", "v1"]).select("v0", "v1", "gap", F.least(F.when(F.col("c") > 1, F.col("first")), F.when(F.col("gap") < 0, F.col("cut")).otherwise(F.col("own"))).alias("by")).where("by is not null")
    found = keys.join(on, ["v0", "v1", "gap"]).where(F.col("by") < F.col("at")).groupBy("at").agg(F.min("by").alias("by"))

    # word by word
    a, b = texts.select("at", F.col("words").alias("a")), texts.select(F.col("at").alias("by"), F.col("words").alias("b"))
    return found.join(a, "at").join(b, "by").where(at_most_one_edit(F.col("a"), F.col("b"))).select("at", "by")


def line_removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """at, by: each line to remove and an earlier line it repeats. A line is its document's id, its text's hash and its number in the text split at line feeds, from 0."""
    lines = lines_of(docs, id_col, text_col, min_words, short)
    h1, h2 = F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2")
    end = lambda sign: F.when(F.col("long"), F.xxhash64(F.lit(sign), ends(F.col("norm"), sign, min_words // 2)))
    keyed = written(lines.select(h1, h2, "at", end(1).alias("head"), end(-1).alias("tail")), "lines-all", plain=True)
    distinct = written(keyed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("times"), F.max("head").alias("head"), F.max("tail").alias("tail")), "lines-distinct", plain=True)
    near = written(near_removals(docs.select(id_col, text_col), distinct, id_col, text_col, min_words), "lines-near")
    settled = distinct.join(near, "at", "left").where("times > 1 or by is not null").select("h1", "h2", F.col("at").alias("first"), "by")
    out = keyed.select("at", "h1", "h2").join(settled, ["h1", "h2"])
    return out.select("at", F.when(F.col("at") != F.col("first"), F.col("first")).otherwise(F.col("by")).alias("by")).where("by is not null")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short: bool = False) -> tuple[DataFrame, str]:
    """``docs`` without the removed lines, and the name of a new last column with their numbers (``removed_lines``, lengthened where docs has one). A text without any line left is ''."""
    name, key, hashed = fresh(docs, "removed_lines"), fresh(docs, "removed_id"), fresh(docs, "removed_text")
    gone = line_removals(docs, id_col, text_col, min_words, short).groupBy(F.col("at.id").alias(key), F.col("at.text").alias(hashed)).agg(F.array_sort(F.collect_set("at.no")).alias(name))
    x = docs.join(gone, docs[id_col].eqNullSafe(gone[key]) & (text_hash(docs[text_col]) == gone[hashed]), "left")
    count = F.octet_length(text_col) - F.octet_length(F.translate(F.col(text_col), "\n", "")) + 1
    left = F.array_except(F.sequence(F.lit(0), count - 1), F.col(name))
    text = F.when(F.col(name).isNull(), F.col(text_col)).otherwise(F.array_join(picked(F.col(text_col), left, lambda line, _: line), "\n"))
    none = F.array().cast("array<int>")
    return x.select(*[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], F.coalesce(name, none).alias(name)), name


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_removed, removed_lines (comma-joined numbers from 0), sha256 of the text that stays."""
    out, gone = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size(gone).cast("long").alias("n_removed"), F.array_join(F.col(gone).cast("array<string>"), ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS no, line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY u(line, i)),
s AS (SELECT doc_id, no, string_split(lower(trim(line, ' ')), ' ') AS ws FROM l),
e AS (SELECT doc_id, no, ws, array_to_string(ws, ' ') AS t FROM s WHERE len(ws) >= 10),
d AS (SELECT t, any_value(ws) AS ws, min({'d': doc_id, 'n': no}) AS a FROM e GROUP BY t),
v AS (SELECT a, g, CASE WHEN g = 0 THEN t ELSE array_to_string(list_concat(ws[1:g - 1], ws[g + 1:len(ws)]), ' ') END AS k FROM d, unnest(range(0, len(ws) + 1)) u(g)),
near AS (SELECT DISTINCT y.a FROM v x JOIN v y ON x.k = y.k AND x.a < y.a AND (x.g = y.g OR x.g = 0 OR y.g = 0)),
gone AS (SELECT e.doc_id, e.no FROM e JOIN d ON e.t = d.t WHERE {'d': e.doc_id, 'n': e.no} <> d.a OR d.a IN (SELECT a FROM near)),
r AS (SELECT doc_id, count(DISTINCT no) AS c, string_agg(no::VARCHAR, ',' ORDER BY no) AS rs FROM (SELECT DISTINCT doc_id, no FROM gone) GROUP BY doc_id),
x AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.no) AS text FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no WHERE g.no IS NULL GROUP BY l.doc_id)
SELECT o.doc_id, coalesce(r.c, 0)::BIGINT AS n_removed, coalesce(r.rs, '') AS removed_lines, sha256(coalesce(x.text, '')) AS text_sha256
FROM documents o LEFT JOIN r ON o.doc_id = r.doc_id LEFT JOIN x ON o.doc_id = x.doc_id
"""
