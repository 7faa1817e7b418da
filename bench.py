"""Times of the headline queries: one JSON line.

The derived treebank is built from $BENCH_SF_DIR and written as Parquet first ("ingest", one shuffle);
patterns then run over the stored sentences, as they would over a corpus that was read once. Each time
is the least of two runs, every result row being produced, none collected.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from arborquill import Treebank, queries
from arborquill.functions.stats import collocations, frequency
from arborquill.sources.derived import derived_sentences, to_conllu

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2

PATTERNS = {
    "node": 'MATCH { V [upos="VERB"]; }',
    "node_regex": "MATCH { W [form=/[a-m].*_(gear|w.+)/]; }",
    "labelled_edge": queries.NSUBJ,
    "chain": queries.CHAIN,
    "precedes": 'MATCH { N [upos="NOUN"]; V [upos="VERB"]; N << V; }',
    "adjacent": 'MATCH { N [upos="NOUN"]; V [upos="VERB"]; N < V; }',
    "not_edge": 'MATCH { V [upos="VERB"]; N [upos="NOUN"]; V !-[obj]-> N; }',
    "siblings": 'MATCH { V [upos="VERB"]; A []; B []; V -[obl]-> A; V -[obl]-> B; }',
    "anonymous": 'MATCH { V [upos="VERB"]; V -[aux:pass]-> _; }',
    "except": 'MATCH { V [upos="VERB"]; } EXCEPT { V -[obj]-> O; }',
    "optional_two": 'MATCH { V [upos="VERB"]; } OPTIONAL { V -[nsubj]-> S; } OPTIONAL { V -[obj]-> O; }',
    "help": queries.HELP,
}
JOINS = ("labelled_edge", "chain", "except", "optional_two")


def produce(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run, times: int = RUNS) -> float:
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - began)
    return round(best, 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    took: dict[str, float] = {}
    try:
        stored, text = f"{folder}/sentences", f"{folder}/conllu"
        produce(derived_sentences(spark, SF_DIR).limit(1))  # starts the session and compiles
        took["ingest"] = timed(lambda: derived_sentences(spark, SF_DIR).write.mode("overwrite").parquet(stored), 1)
        bank = Treebank(spark.read.parquet(stored))
        took["write_conllu"] = timed(lambda: to_conllu(bank.sentences).select("value").write.mode("overwrite").option("lineSep", "\n\n").text(text), 1)
        took["parse_conllu_blocks"] = timed(lambda: produce(Treebank.from_blocks(text, spark).sentences))
        files = [f"{text}/{f}" for f in sorted(os.listdir(text)) if f.startswith("part-")]
        took["parse_conllu_files"] = timed(lambda: produce(Treebank.from_files(files, spark).sentences), 1)
        for name, query in PATTERNS.items():
            took[name] = timed(lambda query=query: produce(bank.search(query, ordered=False)))
        flat = Treebank(bank.sentences, flat=True)
        for name in JOINS:
            took[f"{name}_joins"] = timed(lambda name=name: produce(flat.search(PATTERNS[name], ordered=False)))
        took["filter"] = timed(lambda: produce(bank.filter(queries.NSUBJ, ordered=False)))
        took["ordered"] = timed(lambda: produce(bank.search(queries.NSUBJ)))
        took["lemma_frequency"] = timed(lambda: produce(frequency(bank.search(PATTERNS["node"], ordered=False, fields={"V": ["lemma"]}), "V_lemma")))
        pairs = bank.search('MATCH { V [upos="VERB"]; N [upos="NOUN"]; V -> N; }', ordered=False, fields={"V": ["lemma"], "N": ["lemma"]})
        took["collocations"] = timed(lambda: produce(collocations(pairs, "V_lemma", "N_lemma")))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()
    print(json.dumps({"metric": "total_pattern_search_time", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    sys.exit(main())
