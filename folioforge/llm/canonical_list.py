"""Free-entered values mapped to a canonical list by a pigeonhole join, in SQL.

Every value and every list label is folded and compacted to letters. A label of
length n allows k edits (0 below 5 letters, 1 below 7, 2 below 10, 3 below 13, else 4) and is
cut into k + 1 segments: a value within k edits keeps one segment intact at most
k places away. Substrings of the values are equality-joined to the segments at
such places, survivors are verified with ``levenshtein``, the closest entry wins,
and values without any are reported through an anti-join with entry 0.

Shapes of a value that are tried: as it stands, rotated at a comma, without what
stands before a slash or colon, without brackets, without a tail after a dash.
Labels are also tried with words cut short, against values that hold a full stop.

Defined results: values without a letter and values that are literally a label
are no cases; ties between entries go to the smaller relative distance, then the
longer label, then the smaller id; NULL cells give nothing.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from folioforge.functions.folding import fold_accents
from folioforge.runtime import cut

EDITS = "CASE WHEN length({0}) < 5 THEN 0 WHEN length({0}) < 7 THEN 1 WHEN length({0}) < 10 THEN 2 WHEN length({0}) < 13 THEN 3 ELSE 4 END"

_LABELS = """
WITH words AS (
  SELECT entry_id, split(trim(regexp_replace(folded, '[^a-z0-9]+', ' ')), ' ') AS w FROM _list_labels
), turned AS (
  SELECT entry_id, concat(slice(w, i, size(w)), slice(w, 1, i - 1)) AS w FROM words LATERAL VIEW explode(sequence(1, size(w))) s AS i
), forms AS (
  SELECT entry_id, array_join(w, '') AS ref, false AS cut_short FROM turned
  UNION
  SELECT entry_id, array_join(transform(w, (x, i) -> CASE WHEN i = p THEN substring(x, 1, n) ELSE x END), ''), true
  FROM turned LATERAL VIEW posexplode(w) e AS p, x LATERAL VIEW explode(sequence(3, 7)) s AS n
  WHERE length(x) > n
), sized AS (
  SELECT entry_id, ref, cut_short, {edits} AS k FROM forms WHERE length(ref) > 0
)
SELECT DISTINCT entry_id, ref, cut_short, k, substring(ref, a + 1, b - a) AS seg, a + 1 + shift AS at
FROM (SELECT *, CAST(floor(length(ref) * i / (k + 1)) AS INT) AS a, CAST(floor(length(ref) * (i + 1) / (k + 1)) AS INT) AS b
      FROM sized LATERAL VIEW explode(sequence(0, k)) s AS i)
LATERAL VIEW explode(sequence(-k, k)) t AS shift
WHERE b > a AND a + 1 + shift >= 1
"""

_SHAPES = """
SELECT DISTINCT v, regexp_replace(f5, '[^a-z0-9]+', '') AS form, trim(f5) RLIKE '[a-z][.]' AS dotted
FROM _list_vals
LATERAL VIEW explode(array_distinct(array(folded, regexp_replace(folded, '^([^,]*),(.*)$', '$2 $1')))) a AS f1
LATERAL VIEW explode(array_distinct(array(f1, regexp_replace(f1, '[(].*$| [^ ]*[)]', ' ')))) b AS f2
LATERAL VIEW explode(array_distinct(array(f2, regexp_replace(f2, '^.*[/:]', ''),
                                          regexp_replace(f2, '^[^. ]+[.](?= *[a-z])', '')))) c AS f3
LATERAL VIEW explode(array_distinct(array(f3, regexp_replace(f3, '( -|- ).*$', '')))) d AS f4
LATERAL VIEW explode(array_distinct(array(f4, regexp_replace(f4, '^([^,]*),(.*)$', '$2 $1')))) e AS f5
WHERE length(regexp_replace(f5, '[^a-z0-9]+', '')) > 0
"""

_MATCH = """
WITH grams AS (
  SELECT v, form, dotted, p AS at, substring(form, p, n) AS g
  FROM _list_shapes LATERAL VIEW explode(sequence(1, length(form))) s AS p LATERAL VIEW explode({lens}) l AS n
  WHERE p + n - 1 <= length(form)
), pairs AS (
  SELECT {hint} DISTINCT g.v, g.form, r.entry_id, r.ref, r.k, r.cut_short
  FROM grams g JOIN _list_segs r ON g.g = r.seg AND g.at = r.at
   AND abs(length(g.form) - length(r.ref)) <= r.k AND (g.dotted OR NOT r.cut_short)
), near AS (
  SELECT v, entry_id, levenshtein(form, ref, k) AS d, length(ref) AS n, cut_short FROM pairs
)
SELECT v, min(struct((d + CASE WHEN cut_short THEN 0.5 ELSE 0 END) / n, -n, entry_id)).entry_id AS entry_id
FROM near WHERE d >= 0 GROUP BY v
"""


#: Segments of the list up to which it is broadcast.
MOST_SENT = 100_000


def map_to_list(cells: DataFrame, entries: DataFrame, text: str = "cell") -> DataFrame:
    """``cells`` that are cases, with ``entry_id`` (0: the list has no such entry).

    ``entries`` has ``entry_id`` and any number of label columns. The list is
    small by definition; values are reduced to distinct ones before the join.
    """
    spark = cells.sparkSession
    tag = uuid.uuid4().hex
    own = lambda sql: re.sub(r"\b_list_(\w+)", rf"_list_\1_{tag}", sql)
    names = [c for c in entries.columns if c != "entry_id"]
    labels = entries.select("entry_id", F.explode(F.array(*names)).alias("label")).where("label IS NOT NULL")
    labels.select("entry_id", F.lower(fold_accents(F.col("label"))).alias("folded")).createOrReplaceTempView(own("_list_labels"))
    cut(spark.sql(own(_LABELS.format(edits=EDITS.format("ref")))), "segments").createOrReplaceTempView(own("_list_segs"))
    lens = [r[0] for r in spark.sql(own("SELECT DISTINCT length(seg) FROM _list_segs WHERE length(seg) > 0")).collect()] or [1]
    # the list is sent to every task only while its size is known to be small
    short = spark.table(own("_list_segs")).count() <= MOST_SENT
    hint = "/*+ BROADCAST(r) */" if short else ""
    sent = F.broadcast if short else lambda x: x
    cases = cells.where(F.col(text).rlike(r"\p{L}")).join(
        sent(labels.select(F.col("label").alias("_literal")).distinct()), F.col(text) == F.col("_literal"), "left_anti")
    distinct = cases.select(F.col(text).alias("v")).distinct()
    distinct.select("v", F.translate(F.lower(fold_accents(F.col("v"))), "_", " ").alias("folded")).createOrReplaceTempView(own("_list_vals"))
    wide = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not to be coalesced
    cut(spark.sql(own(_SHAPES)).repartition(wide), "shapes").createOrReplaceTempView(own("_list_shapes"))
    best = cut(spark.sql(own(_MATCH.format(hint=hint, lens=f"array({', '.join(map(str, sorted(lens)))})"))), "list-matches")
    keyed = cases.withColumnRenamed(text, "v")
    found = keyed.join(best, "v")
    missed = keyed.join(best, "v", "left_anti").withColumn("entry_id", F.lit(0))
    return found.unionByName(missed).withColumnRenamed("v", text)
