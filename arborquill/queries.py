"""Queries over the treebank derived from the star schema, and the same in SQL.

``sql`` strings speak of ``words``, one row per word, which ``WORDS_SQL`` defines.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.stats import collocations, frequency
from .nav import children, displacy_table, parents
from .sources.blocks import parse, strict
from .sources.derived import WORDS_SQL, derived_sentences, derived_words, to_conllu
from .streaming import search_stream
from .treebank import Treebank, complete

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HELP = """
MATCH {
    Head [upos="VERB" & feats.Number="Sing"];
    XComp [upos="VERB"];
    Head -[xcomp]-> XComp;
    Head !-[aux:pass]-> _;
    _ !-[conj]-> Head;
    XComp !-[conj]-> _;
    Head << XComp;
}
OPTIONAL { Subj [upos="NOUN"]; Head -[nsubj]-> Subj; }
OPTIONAL { Case []; XComp -[case]-> Case; }
"""
#: The headline of the benches: a chain of four.
CHAIN = 'MATCH { V [upos="VERB"]; A [upos="NOUN"]; B [upos="NOUN"]; P [upos="ADP"]; V -[obj]-> A; A -[nmod]-> B; B -[case]-> P; }'


def treebank(spark: SparkSession, sf_dir: str, flat: bool = False) -> Treebank:
    return Treebank(derived_sentences(spark, sf_dir), derived_words(spark, sf_dir), flat=flat)


def with_words(sql: str) -> str:
    """``sql`` may go on with the list of common tables."""
    return f"WITH {WORDS_SQL.strip()}\n{sql.strip()}"


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = with_words(sql)
        return f

    return register


def pattern(name: str, text: str, sql: str, **options) -> None:
    """A search, nested and as joins; in SQL one row per match."""
    QUERIES[name] = lambda spark, sf_dir: treebank(spark, sf_dir).search(text, ordered=False, **options)
    ORACLE_SQL[name] = with_words(sql)
    if not options:
        QUERIES[f"{name}_joins"] = lambda spark, sf_dir: treebank(spark, sf_dir, flat=True).search(text, ordered=False)
        ORACLE_SQL[f"{name}_joins"] = ORACLE_SQL[name]


def filtered(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: treebank(spark, sf_dir).filter(text, ordered=False).select("sent_id", "n_words", "root")
    ORACLE_SQL[name] = with_words(f"SELECT sent_id, CAST(count(*) AS INT) AS n_words, CAST(max(CASE WHEN head IS NULL THEN idx END) AS INT) AS root FROM words WHERE sent_id IN ({sql}) GROUP BY sent_id")


# sources
@query("words", "SELECT sent_id, idx, form, lemma, upos, xpos, feat_number, feat_tense, misc_spaceafter, head, deprel FROM words")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda c, k: F.expr(f"try_element_at(filter({c}, p -> p.k = '{k}'), 1).v")
    table = derived_words(spark, sf_dir)
    return table.select("sent_id", "idx", "form", "lemma", "upos", "xpos", value("feats", "Number").alias("feat_number"), value("feats", "Tense").alias("feat_tense"), value("misc", "SpaceAfter").alias("misc_spaceafter"), "head", "deprel")


@query("sentences", "SELECT sent_id, CAST(count(*) AS INT) AS n_words, CAST(max(CASE WHEN head IS NULL THEN idx END) AS INT) AS root FROM words GROUP BY sent_id")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_sentences(spark, sf_dir).select("sent_id", "n_words", "root")


CHAIN_SQL = """SELECT v.sent_id, v.idx AS "V", a.idx AS "A", b.idx AS "B", p.idx AS "P" FROM words v JOIN words a ON a.sent_id = v.sent_id AND a.head = v.idx
JOIN words b ON b.sent_id = v.sent_id AND b.head = a.idx JOIN words p ON p.sent_id = v.sent_id AND p.head = b.idx
WHERE v.upos = 'VERB' AND a.upos = 'NOUN' AND a.deprel = 'obj' AND b.upos = 'NOUN' AND b.deprel = 'nmod' AND p.upos = 'ADP' AND p.deprel = 'case'"""
NSUBJ = 'MATCH { V [upos="VERB"]; N [upos="NOUN"]; V -[nsubj]-> N; }'
NSUBJ_SQL = """SELECT v.sent_id, v.idx AS "V", n.idx AS "N" FROM words v JOIN words n ON n.sent_id = v.sent_id AND n.head = v.idx
WHERE v.upos = 'VERB' AND n.upos = 'NOUN' AND n.deprel = 'nsubj'"""


@query("conllu_text", NSUBJ_SQL)
def conllu_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The treebank written as CoNLL-U text, parsed again, then searched."""
    text = to_conllu(derived_sentences(spark, sf_dir))
    return Treebank(complete(strict(parse(text)))).search(NSUBJ, ordered=False)


def shared_folder(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A folder of this application that all executors see; a temporary one within one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.gettempdir()
    return f"{at.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode()):08x}"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id and value, the text of each sentence with its id as a comment."""
    text = to_conllu(derived_sentences(spark, sf_dir))
    return text.select("sent_id", F.concat(F.lit("# id = "), F.col("sent_id"), F.lit("\n"), F.col("value")).alias("value"))


def written(text: DataFrame, folder: str, compression: str = "none") -> list[str]:
    """The files of these texts."""
    text.select("value").write.mode("overwrite").option("lineSep", "\n\n").option("compression", compression).text(folder)
    return sorted(text.sparkSession.read.text(folder).inputFiles())


OWN_ID = "cast(metadata['id'] AS bigint) AS sent_id"


@query("conllu_files", NSUBJ_SQL)
def conllu_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through files in a shared folder and Spark's own splitting reader."""
    folder = shared_folder(spark, "conllu", sf_dir)
    written(numbered(spark, sf_dir), folder)
    return Treebank.from_blocks(folder, spark).search(NSUBJ, ordered=False, keep=("metadata",)).selectExpr(OWN_ID, "V", "N")


def exact(spark: SparkSession, sf_dir: str, name: str) -> Treebank:
    """By the exact reader: sentences of even number from plain files, the others from gzip, and before the
    first word of each a multiword line, which only counts."""
    text = numbered(spark, sf_dir)
    with_line = F.regexp_replace("value", "\n1\t", "\n1-2\tboth\t_\t_\t_\t_\t_\t_\t_\t_\n1\t")
    text = text.withColumn("value", with_line)
    folder = shared_folder(spark, name, sf_dir)
    plain = written(text.where("sent_id % 2 = 0"), f"{folder}/plain")
    return Treebank.from_files(plain + written(text.where("sent_id % 2 = 1"), f"{folder}/gzip", "gzip"), spark)


@query("exact_words", "SELECT sent_id, idx, idx + 1 AS word_id, idx + 1 AS token_id, form, lemma, upos, xpos, feat_number, feat_tense, misc_spaceafter, head, deprel FROM words")
def exact_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of all words, FEATS and MISC among them, and places that count multiword lines."""
    value = lambda c, k: F.expr(f"try_element_at(filter({c}, p -> p.k = '{k}'), 1).v")
    table = exact(spark, sf_dir, "exact-words").sentences.selectExpr(OWN_ID, "inline(words)")
    fields = ("sent_id", "idx", "word_id", "token_id", "form", "lemma", "upos", "xpos", "head", "deprel")
    return table.select(*fields, value("feats", "Number").alias("feat_number"), value("feats", "Tense").alias("feat_tense"), value("misc", "SpaceAfter").alias("misc_spaceafter"))


@query("exact_sentences", "SELECT sent_id, CAST(count(*) AS INT) AS n_words, CAST(max(CASE WHEN head IS NULL THEN idx END) AS INT) AS root, 1 AS n_comments FROM words GROUP BY sent_id")
def exact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = exact(spark, sf_dir, "exact-sentences")
    return bank.sentences.selectExpr(OWN_ID, "n_words", "root", "size(metadata) AS n_comments")


@query("exact_search", f"SELECT x.*, v.lemma AS \"V_lemma\" FROM ({NSUBJ_SQL} AND v.feat_tense = 'Past') x JOIN words v ON v.sent_id = x.sent_id AND v.idx = x.\"V\"")
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'MATCH { V [upos="VERB" & feats.Tense="Past"]; N [upos="NOUN"]; V -[nsubj]-> N; }'
    found = exact(spark, sf_dir, "exact-search").search(text, ordered=False, fields={"V": ["lemma"]}, keep=("metadata",))
    return found.selectExpr(OWN_ID, "V", "N", "V_lemma")


@query("exact_list", "SELECT upos, coalesce(misc_spaceafter, 'Yes') AS space_after, 2 * count(*) AS n FROM words GROUP BY 1, 2")
def exact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of paths, each twice."""
    paths = written(numbered(spark, sf_dir), shared_folder(spark, "exact-list", sf_dir), "gzip")
    words_ = Treebank.from_files(paths + paths, spark).words
    space = F.coalesce(F.expr("try_element_at(filter(misc, p -> p.k = 'SpaceAfter'), 1).v"), F.lit("Yes"))
    return words_.groupBy("upos", space.alias("space_after")).agg(F.count("*").alias("n"))


@query(
    "exact_errors",
    """SELECT 'line 2: Invalid HEAD: x' AS fault, count(DISTINCT sent_id) AS n FROM words WHERE sent_id % 7 = 0 AND sent_id % 2 = 0 HAVING count(*) > 0
UNION ALL SELECT 'line 2: Empty nodes are not supported: 1.1', count(DISTINCT sent_id) FROM words WHERE sent_id % 7 = 0 AND sent_id % 2 = 1 HAVING count(*) > 0
UNION ALL SELECT NULL, count(DISTINCT sent_id) FROM words WHERE sent_id % 7 <> 0 HAVING count(*) > 0""",
)
def exact_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PERMISSIVE: faults stand as rows, what follows them is read."""
    text = numbered(spark, sf_dir)
    head = F.regexp_replace("value", "(\n1\t(?:[^\t]*\t){5})[0-9]+", "$1x")
    empty = F.regexp_replace("value", "\n1\t", "\n1.1\t")
    faulty = F.when(F.expr("sent_id % 7 <> 0"), F.col("value")).when(F.expr("sent_id % 2 = 0"), head).otherwise(empty)
    paths = written(text.withColumn("value", faulty), shared_folder(spark, "exact-errors", sf_dir))
    found = Treebank.from_files(paths, spark).source()
    fault = F.regexp_replace(F.regexp_extract("_error", "Parse error at (line [0-9]+: .*)", 1), "^line [0-9]+", "line 2")
    return found.groupBy(F.when(F.col("_error").isNotNull(), fault).alias("fault")).agg(F.count("*").alias("n"))


@query("stream_search", NSUBJ_SQL)
def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search on a stream of files, run until it has seen all that are there."""
    folder = shared_folder(spark, "stream", sf_dir)
    written(numbered(spark, sf_dir), f"{folder}/in")
    found = search_stream(spark, f"{folder}/in", NSUBJ, keep=("metadata",)).selectExpr(OWN_ID, "V", "N")
    run = f"{folder}/run-{uuid.uuid4().hex}"
    found.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{run}/state").start(f"{run}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{run}/out")


# tests of one word
for _name, _test, _where in (
    ("any", "", "true"),
    ("lemma", 'lemma="gear"', "lemma = 'gear'"),
    ("upos", 'upos="VERB"', "upos = 'VERB'"),
    ("xpos", 'xpos="ECONOMY"', "xpos = 'ECONOMY'"),
    ("form", 'form="old_gear"', "form = 'old_gear'"),
    ("deprel", 'deprel="aux:pass"', "deprel = 'aux:pass'"),
    ("feats", 'feats.Tense="Past"', "feat_tense = 'Past'"),
    ("misc", 'misc.SpaceAfter="No"', "misc_spaceafter = 'No'"),
    ("regex", "form=/[a-m].*_(gear|w.+)/", "regexp_full_match(form, '(?s)[a-m].*_(gear|w.+)')"),
    ("regex_literals", "deprel=/nsubj|obj|obl/", "deprel IN ('nsubj', 'obj', 'obl')"),
    ("regex_feats", "feats.Tense=/P.*t/", "coalesce(regexp_full_match(feat_tense, 'P.*t'), false)"),
    ("not", 'feats.Tense!="Past"', "feat_tense IS DISTINCT FROM 'Past'"),
    ("not_regex", "lemma!=/g.*/", "NOT regexp_full_match(lemma, 'g.*')"),
    ("and", 'upos="VERB" & feats.Number="Sing" & deprel!="root"', "upos = 'VERB' AND feat_number = 'Sing' AND deprel <> 'root'"),
):
    pattern(f"node_{_name}", f"MATCH {{ W [{_test}]; }}", f'SELECT sent_id, idx AS "W" FROM words WHERE {_where}')

_CHILD = "(SELECT 1 FROM words c WHERE c.sent_id = w.sent_id AND c.head = w.idx{})"
for _name, _edge, _where in (
    ("has_head", "_ -> W;", "w.head IS NOT NULL"),
    ("has_head_label", "_ -[conj]-> W;", "w.head IS NOT NULL AND w.deprel = 'conj'"),
    ("no_head", "_ !-> W;", "w.head IS NULL"),
    ("no_head_label", "_ !-[conj]-> W;", "NOT (w.head IS NOT NULL AND w.deprel = 'conj')"),
    ("has_child", "W -> _;", f"EXISTS {_CHILD.format('')}"),
    ("has_child_label", "W -[aux:pass]-> _;", f"EXISTS {_CHILD.format(" AND c.deprel = 'aux:pass'")}"),
    ("no_child", "W !-> _;", f"NOT EXISTS {_CHILD.format('')}"),
    ("no_child_label", "W !-[obj]-> _;", f"NOT EXISTS {_CHILD.format(" AND c.deprel = 'obj'")}"),
    ("ignored", "_ -> _;", "true"),
):
    pattern(f"anonymous_{_name}", f'MATCH {{ W [upos="VERB"]; {_edge} }}', f'SELECT w.sent_id, w.idx AS "W" FROM words w WHERE w.upos = \'VERB\' AND {_where}')

# relations of two words
for _name, _edge, _on in (
    ("child", "V -> N;", "n.head = v.idx"),
    ("child_label", "V -[nsubj]-> N;", "n.head = v.idx AND n.deprel = 'nsubj'"),
    ("not_child", "V !-> N;", "n.head IS DISTINCT FROM v.idx"),
    ("not_child_label", "V !-[obj]-> N;", "NOT (n.head IS NOT DISTINCT FROM v.idx AND n.deprel = 'obj')"),
    ("before", "N << V;", "n.idx < v.idx"),
    ("next", "N < V;", "n.idx + 1 = v.idx"),
    ("same_sentence", "", "true"),
    ("head_after", "N -> V; N << V;", "v.head = n.idx AND n.idx < v.idx"),
):
    pattern(f"edge_{_name}", f'MATCH {{ V [upos="VERB"]; N [upos="NOUN" & feats.Number="Sing"]; {_edge} }}', f'SELECT v.sent_id, v.idx AS "V", n.idx AS "N" FROM words v JOIN words n ON n.sent_id = v.sent_id AND n.idx <> v.idx AND {_on} WHERE v.upos = \'VERB\' AND n.upos = \'NOUN\' AND n.feat_number = \'Sing\'')

pattern("chain", CHAIN, CHAIN_SQL)
pattern(
    "siblings",
    'MATCH { V [upos="VERB"]; A []; B []; V -[obl]-> A; V -[obl]-> B; }',
    """SELECT v.sent_id, v.idx AS "V", a.idx AS "A", b.idx AS "B" FROM words v JOIN words a ON a.sent_id = v.sent_id AND a.head = v.idx AND a.deprel = 'obl'
JOIN words b ON b.sent_id = v.sent_id AND b.head = v.idx AND b.deprel = 'obl' AND b.idx <> a.idx WHERE v.upos = 'VERB'""",
)
_OBJECT = "EXISTS (SELECT 1 FROM words o WHERE o.sent_id = v.sent_id AND o.head = v.idx AND o.deprel = 'obj')"
pattern("except", 'MATCH { V [upos="VERB"]; } EXCEPT { O []; V -[obj]-> O; }', f'SELECT sent_id, idx AS "V" FROM words v WHERE upos = \'VERB\' AND NOT {_OBJECT}')
pattern(
    "except_two",
    'MATCH { V [upos="VERB"]; } EXCEPT { V -[obj]-> O; } EXCEPT { N [upos="NOUN"]; P [upos="ADP"]; V -> N; N << P; }',
    f"""SELECT sent_id, idx AS "V" FROM words v WHERE upos = 'VERB' AND NOT {_OBJECT} AND NOT EXISTS (SELECT 1 FROM words n JOIN words p ON p.sent_id = n.sent_id AND n.idx < p.idx
WHERE n.sent_id = v.sent_id AND n.head = v.idx AND n.upos = 'NOUN' AND p.upos = 'ADP' AND p.idx <> v.idx AND n.idx <> v.idx)""",
)
pattern(
    "except_bound_edge",
    'MATCH { A [upos="VERB"]; B [upos="NOUN"]; A << B; } EXCEPT { A -> B; }',
    """SELECT a.sent_id, a.idx AS "A", b.idx AS "B" FROM words a JOIN words b ON b.sent_id = a.sent_id AND a.idx < b.idx WHERE a.upos = 'VERB' AND b.upos = 'NOUN' AND b.head IS DISTINCT FROM a.idx""",
)
pattern(
    "optional_two",
    'MATCH { V [upos="VERB"]; } OPTIONAL { V -[nsubj]-> S; } OPTIONAL { V -[obj]-> O; }',
    """SELECT v.sent_id, v.idx AS "V", s.idx AS "S", o.idx AS "O" FROM words v LEFT JOIN words s ON s.sent_id = v.sent_id AND s.head = v.idx AND s.deprel = 'nsubj'
LEFT JOIN words o ON o.sent_id = v.sent_id AND o.head = v.idx AND o.deprel = 'obj' WHERE v.upos = 'VERB'""",
)
pattern(
    "optional_pair",
    'MATCH { V [upos="VERB" & deprel="root"]; } OPTIONAL { V -> N; N -> P; }',
    """SELECT v.sent_id, v.idx AS "V", x.n AS "N", x.p AS "P" FROM words v LEFT JOIN (SELECT n.sent_id, n.head, n.idx AS n, p.idx AS p FROM words n JOIN words p ON p.sent_id = n.sent_id AND p.head = n.idx) x
ON x.sent_id = v.sent_id AND x.head = v.idx WHERE v.upos = 'VERB' AND v.deprel = 'root'""",
)
pattern("empty_match", "MATCH { }", "SELECT DISTINCT sent_id FROM words")
pattern(
    "help",
    HELP,
    """SELECT h.sent_id, h.idx AS "Head", x.idx AS "XComp", s.idx AS "Subj", c.idx AS "Case" FROM words h JOIN words x ON x.sent_id = h.sent_id AND x.head = h.idx AND h.idx < x.idx
LEFT JOIN words s ON s.sent_id = h.sent_id AND s.head = h.idx AND s.deprel = 'nsubj' AND s.upos = 'NOUN' LEFT JOIN words c ON c.sent_id = h.sent_id AND c.head = x.idx AND c.deprel = 'case'
WHERE h.upos = 'VERB' AND h.feat_number = 'Sing' AND x.upos = 'VERB' AND x.deprel = 'xcomp' AND NOT (h.head IS NOT NULL AND h.deprel = 'conj')
AND NOT EXISTS (SELECT 1 FROM words w WHERE w.sent_id = h.sent_id AND w.head = h.idx AND w.deprel = 'aux:pass') AND NOT EXISTS (SELECT 1 FROM words w WHERE w.sent_id = h.sent_id AND w.head = x.idx AND w.deprel = 'conj')""",
)
# the other semantics: anchors bind to the outer alternatives; edges between bound words aren't checked
pattern("reference_regex", "MATCH { W [lemma=/g|r/]; }", "SELECT sent_id, idx AS \"W\" FROM words WHERE lemma LIKE 'g%' OR lemma LIKE '%r'", semantics="reference")
pattern(
    "reference_except",
    'MATCH { A [upos="VERB"]; B [upos="NOUN"]; A < B; } EXCEPT { A -[obj]-> B; }',
    """SELECT a.sent_id, a.idx AS "A", b.idx AS "B" FROM words a JOIN words b ON b.sent_id = a.sent_id AND b.idx = a.idx + 1 WHERE a.upos = 'VERB' AND b.upos = 'NOUN' AND b.deprel <> 'obj'""",
    semantics="reference",
)
pattern("reference_self_edge", 'MATCH { A [upos="VERB"]; A << A; }', "SELECT sent_id, idx AS \"A\" FROM words WHERE upos = 'VERB'", semantics="reference")
filtered("filter_node", 'MATCH { V [upos="VERB"]; }', "SELECT sent_id FROM words WHERE upos = 'VERB'")
filtered("filter_edge", NSUBJ, f"SELECT sent_id FROM ({NSUBJ_SQL})")
filtered("filter_except", 'MATCH { V [upos="VERB"]; } EXCEPT { V -[obj]-> O; }', f"SELECT sent_id FROM words v WHERE upos = 'VERB' AND NOT {_OBJECT}")


# order
@query("ordered_first", f"SELECT * FROM ({NSUBJ_SQL}) ORDER BY 1, 2, 3 LIMIT 50")
def ordered_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebank(spark, sf_dir).search(NSUBJ).limit(50)


# navigation
@query("parents", "SELECT w.sent_id, w.idx, p.idx AS parent_idx, p.form AS parent_form, p.upos AS parent_upos FROM words w LEFT JOIN words p ON p.sent_id = w.sent_id AND p.idx = w.head")
def all_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parents(treebank(spark, sf_dir).words).select("sent_id", "idx", "parent_idx", "parent_form", "parent_upos")


def _listed(column: str) -> F.Column:
    return F.concat_ws(",", F.col(column).cast("array<string>"))


@query("children", "SELECT w.sent_id, w.idx, coalesce(string_agg(c.idx::VARCHAR, ',' ORDER BY c.idx), '') AS child_ids FROM words w LEFT JOIN words c ON c.sent_id = w.sent_id AND c.head = w.idx GROUP BY 1, 2")
def all_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children(derived_sentences(spark, sf_dir)).select("sent_id", "idx", _listed("child_ids").alias("child_ids"))


@query("children_label", "SELECT w.sent_id, w.idx, coalesce(string_agg(c.idx::VARCHAR, ',' ORDER BY c.idx), '') AS child_ids FROM words w LEFT JOIN words c ON c.sent_id = w.sent_id AND c.head = w.idx AND c.deprel = 'obj' GROUP BY 1, 2")
def children_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children(derived_sentences(spark, sf_dir), "obj").select("sent_id", "idx", _listed("child_ids").alias("child_ids"))


@query(
    "displacy",
    """, arcs AS (SELECT sent_id, count(head) AS n_arcs, coalesce(string_agg(least(head, idx) || '-' || greatest(head, idx) || ':' || deprel || ':' || CASE WHEN head < idx THEN 'right' ELSE 'left' END, ' ' ORDER BY idx) FILTER (WHERE head IS NOT NULL), '') AS arcs,
string_agg(form || '/' || upos, ' ' ORDER BY idx) AS tokens FROM words GROUP BY sent_id) SELECT * FROM arcs""",
)
def displacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = displacy_table(derived_sentences(spark, sf_dir))
    return table.selectExpr(
        "sent_id",
        "cast(size(arcs) AS bigint) AS n_arcs",
        "array_join(transform(arcs, a -> concat(a.start, '-', a.end, ':', a.label, ':', a.dir)), ' ') AS arcs",
        "array_join(transform(tokens, t -> concat(t.text, '/', t.tag)), ' ') AS tokens",
    )


_UP = """WITH RECURSIVE {words}, up AS (SELECT sent_id, idx AS low, idx AS at, CAST(idx AS VARCHAR) AS path, deprel AS labels FROM words
UNION ALL SELECT u.sent_id, u.low, w.head, w.head || '-' || u.path, p.deprel || '>' || u.labels FROM up u JOIN words w ON w.sent_id = u.sent_id AND w.idx = u.at JOIN words p ON p.sent_id = w.sent_id AND p.idx = w.head)
{rest}"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path down from a verb to an adposition."""
    found = treebank(spark, sf_dir).search('MATCH { X [upos="VERB"]; Y [upos="ADP"]; }', ordered=False, paths={"path": ("X", "Y")})
    return found.where("path IS NOT NULL").select("sent_id", "X", "Y", F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"))


QUERIES["paths"] = paths
ORACLE_SQL["paths"] = _UP.format(
    words=WORDS_SQL.strip(),
    rest="""SELECT u.sent_id, u.at AS "X", u.low AS "Y", u.path FROM up u JOIN words x ON x.sent_id = u.sent_id AND x.idx = u.at JOIN words y ON y.sent_id = u.sent_id AND y.idx = u.low
WHERE u.at <> u.low AND x.upos = 'VERB' AND y.upos = 'ADP'""",
)


def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each sequence of relations leads from a verb to an adposition."""
    bank = treebank(spark, sf_dir)
    found = bank.search('MATCH { X [upos="VERB"]; Y [upos="ADP"]; }', ordered=False, paths={"path": ("X", "Y")}, keep=("sent_id", "words"))
    labels = "array_join(transform(slice(path, 2, size(path)), i -> words[i].deprel), '>')"
    return frequency(found.where("path IS NOT NULL").select(F.expr(labels).alias("labels")), "labels")


QUERIES["path_labels"] = path_labels
ORACLE_SQL["path_labels"] = _UP.format(
    words=WORDS_SQL.strip(),
    rest="""SELECT substr(u.labels, strpos(u.labels, '>') + 1) AS labels, count(*) AS n FROM up u JOIN words x ON x.sent_id = u.sent_id AND x.idx = u.at JOIN words y ON y.sent_id = u.sent_id AND y.idx = u.low
WHERE u.at <> u.low AND x.upos = 'VERB' AND y.upos = 'ADP' GROUP BY 1""",
)


# what analysts do with matches
@query("top_lemmas", "SELECT lemma, count(*) AS n FROM words WHERE upos = 'VERB' GROUP BY lemma ORDER BY n DESC, lemma LIMIT 10")
def top_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = treebank(spark, sf_dir).search('MATCH { V [upos="VERB"]; }', ordered=False, fields={"V": ["lemma"]})
    return frequency(found.withColumnRenamed("V_lemma", "lemma"), "lemma", top=10)


@query(
    "feature_table",
    """SELECT h.sent_id, lower(h.form) AS head_form, x.lemma AS xcomp_lemma, x.idx - h.idx AS distance,
EXISTS (SELECT 1 FROM words o WHERE o.sent_id = h.sent_id AND o.head = h.idx AND o.deprel = 'obj') AS transitive, s.idx IS NOT NULL AS has_subject
FROM words h JOIN words x ON x.sent_id = h.sent_id AND x.head = h.idx AND h.idx < x.idx LEFT JOIN words s ON s.sent_id = h.sent_id AND s.head = h.idx AND s.deprel = 'nsubj' AND s.upos = 'NOUN'
WHERE h.upos = 'VERB' AND x.upos = 'VERB' AND x.deprel = 'xcomp'""",
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'MATCH { Head [upos="VERB"]; XComp [upos="VERB"]; Head -[xcomp]-> XComp; Head << XComp; } OPTIONAL { Subj [upos="NOUN"]; Head -[nsubj]-> Subj; }'
    found = treebank(spark, sf_dir).search(text, ordered=False, fields={"Head": ["form"], "XComp": ["lemma"]}, keep=("sent_id", "words"))
    return found.selectExpr("sent_id", "lower(Head_form) AS head_form", "XComp_lemma AS xcomp_lemma", "XComp - Head AS distance", "exists(words, w -> w.head = Head AND w.deprel = 'obj') AS transitive", "Subj IS NOT NULL AS has_subject")


_LL = " + ".join(f"CASE WHEN {o} > 0 THEN {o} * ln({o} * n / ({e})) ELSE 0 END" for o, e in (("f12", "f1 * f2"), ("(f1 - f12)", "f1 * (n - f2)"), ("(f2 - f12)", "(n - f1) * f2"), ("(n - f1 - f2 + f12)", "(n - f1) * (n - f2)")))


@query(
    "collocations",
    f""", m AS (SELECT v.lemma AS a, n.lemma AS b FROM words v JOIN words n ON n.sent_id = v.sent_id AND n.head = v.idx WHERE v.upos = 'VERB' AND n.upos = 'NOUN'),
p AS (SELECT a, b, count(*) AS f12 FROM m GROUP BY a, b),
t AS (SELECT a, b, f12, CAST(sum(f12) OVER (PARTITION BY a) AS BIGINT) AS f1, CAST(sum(f12) OVER (PARTITION BY b) AS BIGINT) AS f2, CAST(sum(f12) OVER () AS BIGINT) AS n FROM p)
SELECT a, b, f12, f1, f2, n, round(2 * ({_LL}), 6) AS ll FROM (SELECT a, b, f12, f1, f2, n FROM t WHERE f12 > f1 * f2 / n)""",
)
def verb_noun_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = treebank(spark, sf_dir).search('MATCH { V [upos="VERB"]; N [upos="NOUN"]; V -> N; }', ordered=False, fields={"V": ["lemma"], "N": ["lemma"]})
    table = collocations(found.select(F.col("V_lemma").alias("a"), F.col("N_lemma").alias("b")), "a", "b")
    return table.withColumn("ll", F.round("ll", 6))


@query("intransitive", f"SELECT lemma, count(*) AS n FROM words v WHERE upos = 'VERB' AND EXISTS (SELECT 1 FROM words s WHERE s.sent_id = v.sent_id AND s.head = v.idx AND s.deprel = 'nsubj') AND NOT {_OBJECT} GROUP BY lemma")
def intransitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = treebank(spark, sf_dir).search('MATCH { V [upos="VERB"]; V -[nsubj]-> _; V !-[obj]-> _; }', ordered=False, fields={"V": ["lemma"]})
    return frequency(found.withColumnRenamed("V_lemma", "lemma"), "lemma")


@query(
    "matches_by_position",
    f"""SELECT "V", n, CAST(rank() OVER (ORDER BY n DESC, "V") AS INT) AS place FROM (SELECT "V", count(*) AS n FROM ({NSUBJ_SQL}) GROUP BY 1)""",
)
def matches_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of matches by the verb's position, ranked: windows over results, of as many rows as a sentence has words."""
    counts = treebank(spark, sf_dir).search(NSUBJ, ordered=False).groupBy("V").agg(F.count("*").alias("n"))
    return counts.select("V", "n", F.rank().over(Window.orderBy(F.desc("n"), "V")).alias("place"))
