"""Line deduplication with a log-template tree, in DataFrame functions only.

A line's place in the tree is its token count and its leading tokens (a token with a digit counts as a
wildcard). Within such a leaf, a token that occurs at its position in one document alone is a variable
field and becomes a wildcard too. A template that recurs across documents stays in the document with
the smallest doc_id and is dropped from the others. Lines with too few tokens for a template are
compared as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Leading tokens that lead to a leaf, the fewest tokens of a line that may have wildcards, and the
#: least share of constant tokens after the leading ones in a template.
LEADING = 3
MIN_TOKENS = 5
MIN_CONSTANT = 0.6
WILDCARD = "<*>"
#: Bits of a filter that tells before a shuffle which keys can't match; 64 of them share a row, so the
#: filter is a table of 2 ** (FILTER_BITS - 6) rows at most and may be broadcast.
FILTER_BITS = 24
#: A line with more than 1 / HOT_LINES of all copies is joined by broadcast; there are fewer than HOT_LINES such lines.
HOT_LINES = 1024


def _squeezed(line: Column) -> Column:
    """Tokens separated by single blanks."""
    return F.trim(F.when(line.rlike("[\\x09-\\x0D]|  "), F.regexp_replace(line, "[\\x09-\\x0D ]+", " ")).otherwise(line))


def _masked(line: Column) -> Column:
    """Tokens that hold a digit become wildcards. Each token is looked at once, from its start, so long ones cost no more."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILDCARD)).otherwise(line)


def _lines(docs: DataFrame, leading: int, min_tokens: int) -> DataFrame:
    """doc_id, text_hash, pos, n, leaf, masked, line_hash: a row for each line that holds a token."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("plain", _squeezed(F.col("line"))).filter("plain <> ''")
    rows = rows.withColumn("n", F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    rows = rows.withColumn("masked", F.when(F.col("n") >= min_tokens, _masked(F.col("plain"))).otherwise(F.col("plain")))
    leaf, line_hash = F.xxhash64("n", F.substring_index("masked", " ", leading)), F.xxhash64("masked")
    return rows.select("doc_id", "text_hash", "pos", "n", leaf.alias("leaf"), "masked", line_hash.alias("line_hash"))


def _slot(key: Column) -> tuple[Column, Column]:
    """Row of the filter, and the bit there."""
    h = F.xxhash64(key).bitwiseAND((1 << FILTER_BITS) - 1)
    return F.shiftright(h, 6).cast("int"), h.bitwiseAND(63).cast("int")


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """(_row, _bits): the filter of the given keys. With very many keys it lets everything pass, and joins decide alone."""
    row, bit = _slot(F.col(key))
    marks = keys.select(row.alias("_row"), bit.alias("_bit")).distinct()
    return common.stored(marks.groupBy("_row").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits")), "filter")


def _marked(rows: DataFrame, found: DataFrame, key: Column) -> DataFrame:
    """``rows`` with _may: whether the key can be among the filter's."""
    row, bit = _slot(key)
    wide = rows.withColumns({"_slot_row": row, "_slot_bit": bit})
    joined = wide.join(F.broadcast(found), F.col("_slot_row") == F.col("_row"), "left")
    may = F.coalesce(F.getbit("_bits", F.col("_slot_bit")) == 1, F.lit(False))
    return joined.withColumn("_may", may).drop("_slot_row", "_slot_bit", "_row", "_bits")


def dropped_lines(docs: DataFrame, leading: int = LEADING, min_tokens: int = MIN_TOKENS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """doc_id, text_hash, word, bits: which lines documents lose, 64 of them to a word of bits."""
    lines = common.stored(_lines(docs, leading, min_tokens), "lines")
    line, kept = ["leaf", "line_hash"], F.min("keep_in").alias("keep_in")
    own = lines.groupBy(*line, "n").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("copies"))
    own = common.stored(own, "own")
    total = own.agg(F.sum("copies")).first()[0] or 0
    leaves = own.filter(F.col("n") >= min_tokens).groupBy("leaf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("held"))
    mixed = common.stored(leaves.filter("lo < hi and held > 1").select("leaf"), "leaves")
    # leaves that hold different lines: which of their tokens are constant?
    texts = _marked(lines.filter(F.col("n") >= min_tokens).select(*line, "n", "masked", "doc_id"), key_filter(mixed, "leaf"), F.col("leaf")).filter("_may").drop("_may")
    texts = texts.join(mixed, "leaf", "left_semi")
    texts = texts.groupBy(*line, "n").agg(F.first("masked").alias("masked"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("copies"))
    texts = common.stored(texts, "texts")
    tokens = texts.select(*line, "lo", "hi", F.posexplode(F.split("masked", " ")).alias("at", "token")).filter((F.col("at") >= leading) & (F.col("token") != WILDCARD))
    constant = tokens.groupBy("leaf", "at", "token").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first < last").select("leaf", "at", "token")
    shape = tokens.join(constant, ["leaf", "at", "token"]).groupBy(*line).agg(F.count("*").alias("constants"), F.bit_xor(F.xxhash64("at", "token")).alias("shape"))
    general = texts.drop("masked").join(shape, line).filter(F.col("constants") >= F.ceil(F.lit(min_constant) * (F.col("n") - leading)))
    recurring = general.groupBy("leaf", "shape", "constants").agg(F.min("lo").alias("keep_in"), F.max("hi").alias("hi")).filter("keep_in < hi").drop("hi")
    by_template = general.join(recurring, ["leaf", "shape", "constants"]).select(*line, "keep_in", "copies")
    # a line that recurs as it stands needs no wildcard
    verbatim = own.filter("lo < hi").select(*line, F.col("lo").alias("keep_in"), "copies")
    decided = common.stored(verbatim.unionByName(by_template).groupBy(*line).agg(kept, F.max("copies").alias("copies")), "decided")
    common_line = F.col("copies") * HOT_LINES > total
    hot, rare = (decided.filter(x).select(*line, "keep_in") for x in (common_line, ~common_line))
    slim = lines.select("doc_id", "text_hash", "pos", *line)
    goes = slim.join(F.broadcast(hot), line).unionByName(slim.join(F.broadcast(hot), line, "left_anti").join(rare, line)).filter("doc_id > keep_in")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))
    return goes.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the recurring lines cut from ``text``, and two more columns: line_count, dropped_count.

    A null text stays null and has no lines; an empty text is one empty line; lines without a token
    stay; lines of fewer than MIN_TOKENS tokens go only where they recur as they stand; repeats inside
    one document do not count as recurring; rows that share a doc_id are one document for counting; a
    document with a null doc_id neither counts nor loses lines; a long line or text costs in proportion
    to its length; an empty table gives no rows; other columns pass through, whatever their names, and
    a clash of the two new names gets an underscore.
    """
    total, gone = common.free_name(docs.columns, "line_count"), common.free_name(docs.columns, "dropped_count")
    words = dropped_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    flags = words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by_word"), F.max("word").alias("last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.col("by_word")[w], F.lit(0).cast("long")))
    flags = common.stored(flags.select(F.col("doc_id").alias("flag_id"), F.col("text_hash").alias("flag_hash"), dense.alias("flags"), F.xxhash64("doc_id", "text_hash").alias("flag_key")), "flags")
    # the columns of docs travel in one struct, so that none can clash with a helper; documents that lose nothing need not move
    rows = docs.select(common.whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    marked = _marked(rows, key_filter(flags, "flag_key"), F.xxhash64("id", "hash"))
    moved = marked.filter("_may").join(flags, (F.col("id") == F.col("flag_id")) & (F.col("hash") == F.col("flag_hash")), "left").select("row", "flags")
    both = marked.filter("not _may").select("row", F.lit(None).cast("array<bigint>").alias("flags")).unionByName(moved)
    text = F.col("row").getField("text")
    split = F.split(text, "\n")
    lost = lambda i: F.getbit(F.coalesce(F.get("flags", F.shiftright(i, 6)), F.lit(0).cast("long")), i.bitwiseAND(63)) == 1
    new = F.when(F.col("flags").isNull(), text).otherwise(F.array_join(F.filter(split, lambda line, i: ~lost(i)), "\n"))
    dropped = F.when(F.col("flags").isNull(), 0).otherwise(F.aggregate("flags", F.lit(0), lambda n, bits: n + F.bit_count(bits)))
    columns = [(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return both.select(*columns, F.coalesce(F.size(split), F.lit(0)).cast("long").alias(total), dropped.cast("long").alias(gone))


def keep_fresh(docs: DataFrame) -> DataFrame:
    """The documents without their recurring lines; one that has nothing else goes. n_chars, where there, follows."""
    cut = dedup_lines(docs)
    gone = cut.columns[-1]
    left = cut.filter((F.col(gone) == 0) | F.col("text").rlike("[^\\x09-\\x0D ]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*common.plain(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "line_count", "dropped_count", "text")


ORACLE_SQL = """
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), masked AS (
  SELECT doc_id, text, pos, line, trim(regexp_replace(line, '[\\x09-\\x0D ]+', ' ', 'g'), ' ') AS plain FROM split
), counted AS (
  SELECT *, CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS n,
         CASE WHEN len(string_split(plain, ' ')) >= 5 THEN regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE plain END AS masked
  FROM masked
), lines AS (
  SELECT *, string_split(masked, ' ')[1:3] AS lead FROM counted
), own AS (
  SELECT n, lead, masked, min(doc_id) AS lo, max(doc_id) AS hi FROM lines WHERE n >= 1 GROUP BY ALL
), tokens AS (
  SELECT n, lead, masked, lo, hi, unnest(string_split(masked, ' ')) AS token, generate_subscripts(string_split(masked, ' '), 1) AS spot FROM own WHERE n >= 5
), constant AS (
  SELECT n, lead, spot, token FROM tokens WHERE spot > 3 AND token <> '<*>' GROUP BY ALL HAVING min(lo) < max(hi)
), shapes AS (
  SELECT n, lead, masked, lo, hi, count(*) AS constants, string_agg(spot || ':' || token, ' ' ORDER BY spot) AS shape
  FROM tokens JOIN constant USING (n, lead, spot, token) GROUP BY ALL
), general AS (
  SELECT * FROM shapes WHERE constants >= ceil(CAST(0.6 AS DOUBLE) * (n - 3))
), recurring AS (
  SELECT n, lead, shape, min(lo) AS keep_in FROM general GROUP BY ALL HAVING min(lo) < max(hi)
), decided AS (
  SELECT n, lead, masked, min(keep_in) AS keep_in FROM (
    SELECT n, lead, masked, keep_in FROM general JOIN recurring USING (n, lead, shape)
    UNION ALL SELECT n, lead, masked, lo FROM own WHERE lo < hi
  ) GROUP BY ALL
), flagged AS (
  SELECT l.doc_id, l.text, l.pos, l.line, coalesce(l.doc_id > d.keep_in, FALSE) AS gone
  FROM lines l LEFT JOIN decided d ON l.n = d.n AND l.lead = d.lead AND l.masked = d.masked
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS line_count, CAST(count_if(gone) AS BIGINT) AS dropped_count,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM flagged GROUP BY doc_id, flagged.text
"""
