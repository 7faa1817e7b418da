"""A treebank derived from the star schema: each order is a sentence, its lines are the words.

Words stand in the order of (line number, part, supplier). In the order k of (part, supplier, line
number) the first is the root, and each other hangs on the one at place (supplier mod k), so heads lie
on both sides and arcs may cross.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAIRS, WORD_FIELDS, nest


def derived_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``words``: lines meet their parts, then one shuffle by order gathers them; both orders and the heads are
    found within an array, and all else is plain columns of the words that come out of it.

    What is dealt out are plain rows, as gathering before it would find next to no two lines of an order; it doesn't
    depend on the columns that a query asks for, so that scans of one query share it. Lines that tie in both orders
    go by their other fields."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    both = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    line = "struct(l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS f, l_linestatus AS t, p_name AS name, p_type AS type)"
    found = both.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("sent_id")).agg(F.sort_array(F.collect_list(F.expr(line))).alias("w"))
    found = found.withColumn("by_k", F.expr("sort_array(transform(w, (x, i) -> struct(x.p AS p, x.s AS s, x.n AS n, i AS i)))"))
    link = "struct(y.i AS i, k AS k, CASE WHEN k > 0 THEN get(by_k, cast(y.s % k AS int)).i END AS head)"
    found = found.withColumn("links", F.expr(f"sort_array(transform(by_k, (y, k) -> {link}))"))
    found = found.select("sent_id", "links", F.posexplode("w").alias("idx", "x")).select("sent_id", "idx", "x", F.expr("get(links, idx)").alias("link"))
    pair = lambda k, v: f"named_struct('k', '{k}', 'v', {v})"
    tense = pair("Tense", "CASE WHEN x.n % 2 = 0 THEN 'Past' ELSE 'Pres' END")
    field = {
        "idx": "idx", "word_id": "idx", "token_id": "idx + 1", "form": "replace(x.name, ' ', '_')", "lemma": "split_part(x.name, ' ', 2)",
        "upos": "CASE x.f WHEN 'A' THEN 'VERB' WHEN 'N' THEN 'NOUN' ELSE 'ADP' END", "xpos": "x.type",
        "feats": f"concat(array({pair('Number', "CASE x.t WHEN 'O' THEN 'Sing' ELSE 'Plur' END")}), CASE WHEN x.f = 'A' THEN array({tense}) ELSE cast(array() AS {PAIRS}) END)",
        "head": "link.head",
        "deprel": """CASE WHEN link.k = 0 THEN 'root' WHEN x.f = 'R' THEN 'case'
            WHEN x.f = 'N' THEN element_at(array('nsubj', 'obj', 'obl', 'nmod'), cast(x.p % 4 AS int) + 1)
            ELSE element_at(array('xcomp', 'conj', 'aux:pass'), cast(x.p % 3 AS int) + 1) END""",
        "misc": f"CASE WHEN x.n % 4 = 0 THEN array({pair('SpaceAfter', "'No'")}) ELSE cast(array() AS {PAIRS}) END",
    }
    return found.selectExpr("sent_id", *(f"{field[k]} AS {k}" for k in WORD_FIELDS))


def derived_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sentences``: the words, gathered again where they are, without another shuffle."""
    return nest(derived_words(spark, sf_dir)).withColumns({"file_no": F.lit(0), "sent_no": F.col("sent_id").cast("int")})


#: The same words as SQL, flat: feats and misc as one column each, null where there's none.
WORDS_SQL = """
b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, p_name, p_type,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS k
  FROM lineitem JOIN part ON p_partkey = l_partkey),
words AS (SELECT b.l_orderkey AS sent_id, CAST(b.i AS INT) AS idx, replace(b.p_name, ' ', '_') AS form, split_part(b.p_name, ' ', 2) AS lemma,
    CASE b.l_returnflag WHEN 'A' THEN 'VERB' WHEN 'N' THEN 'NOUN' ELSE 'ADP' END AS upos, b.p_type AS xpos,
    CASE b.l_linestatus WHEN 'O' THEN 'Sing' ELSE 'Plur' END AS feat_number,
    CASE WHEN b.l_returnflag = 'A' THEN CASE WHEN b.l_linenumber % 2 = 0 THEN 'Past' ELSE 'Pres' END END AS feat_tense,
    CASE WHEN b.l_linenumber % 4 = 0 THEN 'No' END AS misc_spaceafter,
    CAST(h.i AS INT) AS head,
    CASE WHEN b.k = 0 THEN 'root' WHEN b.l_returnflag = 'R' THEN 'case'
      WHEN b.l_returnflag = 'N' THEN CASE b.l_partkey % 4 WHEN 0 THEN 'nsubj' WHEN 1 THEN 'obj' WHEN 2 THEN 'obl' ELSE 'nmod' END
      ELSE CASE b.l_partkey % 3 WHEN 0 THEN 'xcomp' WHEN 1 THEN 'conj' ELSE 'aux:pass' END END AS deprel
  FROM b LEFT JOIN b h ON h.l_orderkey = b.l_orderkey AND b.k > 0 AND h.k = CASE WHEN b.k > 0 THEN b.l_suppkey % b.k END)"""


def to_conllu(sentences: DataFrame) -> DataFrame:
    """sent_id and value, each sentence's text in CoNLL-U without the empty line after it."""
    cell = lambda pairs: f"CASE WHEN size({pairs}) = 0 THEN '_' ELSE array_join(transform({pairs}, p -> concat(p.k, '=', p.v)), '|') END"
    line = f"array_join(array(cast(w.token_id AS string), w.form, w.lemma, w.upos, w.xpos, {cell('w.feats')}, coalesce(cast(w.head + 1 AS string), '0'), w.deprel, '_', {cell('w.misc')}), '\\t')"
    comments = "transform(array_sort(map_entries(coalesce(metadata, map()))), e -> concat('# ', e.key, ' = ', e.value))"
    text = "CASE WHEN text IS NULL THEN cast(array() AS array<string>) ELSE array(concat('# text = ', text)) END"
    return sentences.select("sent_id", F.expr(f"array_join(concat({text}, {comments}, transform(words, w -> {line})), '\\n')").alias("value"))
