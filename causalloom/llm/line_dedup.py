"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize, meet

#: Inside a run of repeated lines a chunk ends where the rolling hash over a line and the one before is 0 modulo this.
DIVISOR = 2
HASH_MODULUS = 1 << 31
#: A single line of more words than this is a passage and may go alone.
PASSAGE_WORDS = 50

#: Names of working columns; whatever docs has beside them stays apart.
KEY, TEXT, MINE = "__dedup_id", "__dedup_text", "__dedup_lines"


def _line_hash(line: Column) -> Column:
    """31 bits of md5: the same in any engine."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % HASH_MODULUS


def _words(line: Column) -> Column:
    """Words of a line: runs of other characters than space, tab and carriage return."""
    return F.size(F.array_remove(F.split(F.translate(line, "\t\r", "  "), " "), ""))


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  ")) == ""


def _chunks(lines: Column, repeated: Column, passage_words: int | None) -> Column:
    """Chunks of a text that may go, in order: array of struct(s first line, e last line).

    `repeated` are the numbers of the lines that stand twice or more anywhere. Blank lines
    between these belong to them. A run of them is cut where the rolling hash says so; the
    hash covers two lines of the run, and a run's first and last line are never cut off
    alone. So chunks depend on the run's own lines, not on the text around it, and after an
    insertion the same cuts fall in the same places again. All steps are linear in the lines.
    """

    def runs(p: Column) -> Column:
        def starts(k: Column) -> Column:
            return F.coalesce(F.get(p, k - 1) != F.get(p, k) - 1, F.lit(True))

        def stops(k: Column) -> Column:
            return F.coalesce(F.get(p, k + 1) != F.get(p, k) + 1, F.lit(True))

        def with_hashes(h: Column) -> Column:
            def rolls(k: Column) -> Column:
                return F.coalesce((F.get(h, k - 1) * 31 + F.get(h, k)) % HASH_MODULUS % DIVISOR == 0, F.lit(False)) & ~starts(k)

            def ends(k: Column) -> Column:
                return stops(k) | (rolls(k) & ~stops(k + 1) & ~rolls(k - 1))

            def pieces(last: Column) -> Column:
                return F.transform(last, lambda e, j: F.struct(F.get(p, F.coalesce(F.get(last, j - 1) + 1, F.lit(0))).alias("s"), F.get(p, e).alias("e")))

            return let(F.filter(F.sequence(F.lit(0), F.size(p) - 1), ends), pieces)

        return let(F.transform(p, lambda i: _line_hash(F.get(lines, i))), with_hashes)

    def inner(p: Column) -> Column:
        """Without the blank lines at a run's ends."""
        return F.filter(p, lambda i, k: ~_blank(F.get(lines, i)) | (F.coalesce((F.get(p, k - 1) == i - 1) & (F.get(p, k + 1) == i + 1), F.lit(False))))

    def may_go(x: Column) -> Column:
        part = F.slice(lines, x["s"] + 1, x["e"] - x["s"] + 1)
        several = F.size(F.filter(part, lambda line: ~_blank(line))) >= 2
        return several if passage_words is None else several | (_words(F.get(lines, x["s"])) > passage_words)

    blanks = F.filter(F.transform(lines, lambda x, i: F.when(_blank(x), i)), lambda i: i.isNotNull())
    return F.filter(let(let(F.array_sort(F.concat(repeated, blanks)), inner), runs), may_go)


def _marked(docs: DataFrame, id_col: str, text_col: str, passage_words: int | None) -> DataFrame:
    """docs with, for each row, the chunks to drop (null: none), written once.

    Steps: (1) hash the lines where the text stands and count the hashes in a partial
    aggregation; lines whose hash comes twice or more report their numbers, without a hot
    key (meet); (2) texts meet these numbers and are written; (3) the chunks made of such
    lines are grouped by their bytes; each one's first place (least id, text hash, line)
    stays, the others are dropped. First places are minima in a partial aggregation, so a
    chunk that a third of all documents share costs one row a task, and what is not a
    first place is found by an anti join on places, which no chunk can skew.
    """
    rows = docs.withColumns({KEY: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), TEXT: F.coalesce(F.col(text_col).cast("string"), F.lit(""))})
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(KEY).alias("key"), F.split(F.col(TEXT), "\n").alias("all"))
    hashed = own.select("id", "key", F.posexplode(F.transform("all", lambda x: F.when(~_blank(x), F.xxhash64(x))))).where(F.col("col").isNotNull())
    hashed = materialize(hashed.select("id", "key", "pos", F.col("col").alias("h")), "line-hashes")
    twice = materialize(hashed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1), "line-counts")
    wanted = meet(hashed, twice, "h", hashed.count()).groupBy("id", "key").agg(F.collect_set("pos").alias("maybe"))
    wanted = wanted.select(F.col("id").alias("__dedup_wid"), F.col("key").alias("__dedup_wkey"), F.col("maybe").alias(MINE))
    same = (rows[KEY] == F.col("__dedup_wkey")) & rows[id_col].cast("long").eqNullSafe(F.col("__dedup_wid"))
    held = materialize(rows.join(wanted, same, "left").select(*[rows[c] for c in docs.columns], KEY, MINE), "line-texts")
    discard(hashed, twice)
    some = held.where(F.col(MINE).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(KEY).alias("key"), F.col(text_col).cast("string").alias("t"), F.col(MINE).alias("maybe"))
    found = let(F.split("t", "\n"), lambda lines: F.transform(
        _chunks(lines, F.col("maybe"), passage_words), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array_join(F.slice(lines, x["s"] + 1, x["e"] - x["s"] + 1), "\n").alias("c")),
    ))
    texts = materialize(some.select("id", "key", F.explode(found).alias("x")).select("id", "key", "x.s", "x.e", "x.c"), "chunk-bytes")
    first = texts.groupBy("c").agg(F.min(F.struct("id", "key", "s")).alias("x")).select(F.col("x.id").alias("f_id"), F.col("x.key").alias("f_key"), F.col("x.s").alias("f_s"))
    is_first = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")) & (F.col("s") == F.col("f_s"))
    drop = texts.select("id", "key", "s", "e").join(first, is_first, "left_anti")
    drop = drop.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("__dedup_drop")).select(F.col("id").alias("__dedup_wid"), F.col("key").alias("__dedup_wkey"), "__dedup_drop")
    same = (F.col(KEY) == F.col("__dedup_wkey")) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__dedup_wid"))
    touched = held.where(F.col(MINE).isNotNull()).join(drop, same, "left").drop("__dedup_wid", "__dedup_wkey")
    untouched = held.where(F.col(MINE).isNull()).withColumn("__dedup_drop", F.lit(None).cast("array<struct<s:int,e:int>>"))
    return touched.unionByName(untouched).drop(MINE, KEY)


def _kept_text(text: Column, drop: Column) -> Column:
    """What the dropped chunks, in order, leave of a text: the stretches of lines between them."""

    def stretches(lines: Column) -> Column:
        def between(j: Column) -> Column:
            lo = F.coalesce(F.get(drop, j - 1)["e"] + 1, F.lit(0))
            hi = F.coalesce(F.get(drop, j)["s"], F.size(lines))
            return F.slice(lines, lo + 1, F.greatest(hi - lo, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), between)), "\n")

    return F.when(drop.isNull(), text).otherwise(let(F.split(text, "\n"), stretches))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """Remove chunks of lines that stand elsewhere before.

    Lines that stand twice or more in all texts form runs; a rolling hash over line hashes
    cuts runs into chunks. A chunk of two or more lines with a word that stands twice or
    more in all texts, as the same bytes, stays only at its first place, by id, then by a
    hash of the text, then by its line. So does a single line of over passage_words words
    (null: single lines always stay): a passage that is laid out on one line. What is left
    is joined again.

    Returns doc_id, text, n_lines, n_removed (chunks) and removed_chars. A null text stays
    null, with 0 of each; an empty text has one empty line. Rows equal in id and text are
    one document: all of them get the same text (and each counts when lines are counted).
    Null ids come first in order. A text may become empty; its row stays. Other columns are
    ignored. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _marked(own, "doc_id", "text", passage_words)
    text = F.col("text")
    out = rows.select(
        "doc_id", _kept_text(text, F.col("__dedup_drop")).alias("text"),
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("__dedup_drop")), F.lit(0)).cast("long").alias("n_removed"), F.length(text).alias("before"),
    )
    return out.select(
        "doc_id", "text", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.greatest(F.col("n_removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.col("before") - F.length("text"), F.lit(0)).cast("long").alias("removed_chars"),
    )


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """docs with the texts of dedup_lines(); every row and all other columns stay as they are."""
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    aside = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    rows = _marked(aside, names[id_col], names[text_col], passage_words)
    return rows.select(*[(_kept_text(F.col(a).cast("string"), F.col("__dedup_drop")) if c == text_col else F.col(a)).alias(c) for c, a in names.items()])


#: The same in DuckDB: repeated lines, runs of them, chunks, the first place of each, what is left.
SQL = r"""
WITH counted AS (
  SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY line HAVING count(*) > 1
), lines AS (
  SELECT doc_id, text, i, line, trim(translate(line, chr(9) || chr(13), '  ')) = '' AS blank
  FROM (SELECT doc_id, text, unnest(range(0, len(ls))) AS i, unnest(ls) AS line
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)))
), near AS (
  SELECT *, coalesce(lag(i) OVER w = i - 1 AND lead(i) OVER w = i + 1, false) AS inside
  FROM lines WHERE blank OR line IN (SELECT line FROM counted) WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
), run AS (
  SELECT doc_id, text, i, line, blank, ('0x' || substr(md5(line), 1, 8))::BIGINT % 2147483648 AS h,
         coalesce(lag(i) OVER w <> i - 1, true) AS starts, coalesce(lead(i) OVER w <> i + 1, true) AS stops
  FROM near WHERE NOT blank OR inside WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
), rolled AS (
  SELECT *, NOT starts AND (lag(h) OVER w * 31 + h) % 2147483648 % 2 = 0 AS rolls
  FROM run WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
), ended AS (
  SELECT *, stops OR (rolls AND NOT lead(stops) OVER w AND NOT lag(rolls) OVER w) AS ends
  FROM rolled WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ended
), chunk AS (
  SELECT doc_id, text, min(i) AS s, max(i) AS e, string_agg(line, chr(10) ORDER BY i) AS c
  FROM numbered GROUP BY doc_id, text, pos
  HAVING count(*) FILTER (NOT blank) >= 2
      OR len(list_filter(string_split(translate(arg_min(line, i), chr(9) || chr(13), '  '), ' '), lambda x: x <> '')) > 50
), placed AS (
  SELECT doc_id, text, s, e, row_number() OVER (PARTITION BY c ORDER BY doc_id, s) > 1 AS gone FROM chunk
), dropped AS (SELECT doc_id, text, s, e FROM placed WHERE gone
), kept AS (
  SELECT l.doc_id, l.text, l.i, l.line FROM lines l LEFT JOIN dropped d ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND d.text = l.text AND l.i BETWEEN d.s AND d.e
  WHERE d.s IS NULL
), left_over AS (SELECT doc_id, text AS before, string_agg(line, chr(10) ORDER BY i) AS text FROM kept GROUP BY doc_id, text
), removed AS (SELECT doc_id, text AS before, count(*) AS n FROM dropped GROUP BY doc_id, text)
SELECT o.doc_id, CASE WHEN o.text IS NOT NULL THEN coalesce(l.text, '') END AS text, coalesce(len(string_split(o.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(length(o.text) - length(coalesce(l.text, '')), 0)::BIGINT AS removed_chars
FROM documents o LEFT JOIN left_over l ON o.doc_id IS NOT DISTINCT FROM l.doc_id AND o.text = l.before
LEFT JOIN removed r ON o.doc_id IS NOT DISTINCT FROM r.doc_id AND o.text = r.before
"""
