import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoping.llm import license_scan, mixing, registry
from geoping.llm.common import components

DATA = "/root/testdata/sf0.01"


def test_licence_scan_matches_brute_force(frame, messy):
    rnd = random.Random(8)
    names = list(license_scan.TEMPLATES)
    docs = [p for p in messy if len(p[1] or "") < 5000]
    for i in range(60):
        words = license_scan.TEMPLATES[rnd.choice(names)].split()
        for _ in range(rnd.choice((0, 0, 1, 2))):
            words[rnd.randrange(len(words))] = "changed"
        docs.append((500 + i, " ".join(["lead"] * rnd.randint(0, 40) + words + ["tail"] * rnd.randint(0, 40))))
    out = license_scan.scan(frame(docs), license_scan.TEMPLATES, ["doc_id", "row", "label"]).collect()
    got = sorted((str(r.row.doc_id), ",".join(sorted(r.licences))) for r in out)
    exp = [(str(i), {k for k, v in license_scan.brute_force(t, license_scan.TEMPLATES).items() if v}) for i, t in docs]
    # a larger window can hold more of a template than one of its own length: never less
    assert all(want <= set(have.split(",")) for (_, have), (_, want) in zip(got, sorted(exp, key=lambda e: (e[0], ",".join(sorted(e[1])))), strict=True))
    assert sum(len(w) for _, w in exp) > 30 and sum(h != ",".join(sorted(w)) for (_, h), (_, w) in zip(got, sorted(exp, key=lambda e: (e[0], ",".join(sorted(e[1])))), strict=True)) <= 3


def test_licence_bands_and_edges(frame):
    for c in license_scan.classes(license_scan.TEMPLATES):
        assert c.bands >= 1
    assert license_scan.scan(frame([]), license_scan.TEMPLATES, ["doc_id"]).collect() == []
    assert all(r.licences == {} for r in license_scan.scan(frame([(1, "All rights reserved.")]), {"none": "", "nil": None}, ["doc_id"]).collect())


def oracle(name, sf_dir=DATA, documents=None):
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{sf_dir}/benchmark.parquet'")
    if documents is None:
        con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    else:
        con.register("documents", documents)
    return con.execute(registry.ORACLE[name]).df()


@pytest.mark.parametrize("name", ["op6_decontamination", "op8_mixing", "op9_jaccard_join"])
def test_queries_match_their_sql(spark, name):
    got, exp = registry.QUERIES[name](spark, DATA).toPandas(), oracle(name)
    cols = sorted(exp.columns)
    assert sorted(got.columns) == cols and len(got) == len(exp)
    assert (got[cols].sort_values(cols).astype(str).values == exp[cols].sort_values(cols).astype(str).values).all()


def test_mixing_of_messy_rows(spark, frame, messy, tmp_path):
    docs = frame(messy).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4))).withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).otherwise("en"))
    out = mixing.mixed_documents(docs).select("row.doc_id", "epoch", "domain", "lang", "source", "tokens", "budget").toPandas()
    exp = oracle("op8_mixing", documents=docs.toPandas())
    cols = sorted(exp.columns)
    canon = lambda d: sorted(tuple("" if v != v or v is None else str(v).removesuffix(".0") for v in r) for r in d[cols].itertuples(index=False))
    assert canon(out) == canon(exp)
    assert mixing.mixed_documents(frame([])).collect() == []


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 5), ("b", "x", "4", 1000), ("b", "z", "5", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, {"domain": {("a",): 1.0, ("b",): 1.0}}, 400, 1).collect()}
    assert got == {"1": 10, "2": 185, "3": 5, "4": 100, "5": 100}
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves.where("source <> '2'"), {}, 400, 1).collect()}
    assert got == {"1": 10, "3": 5, "4": 192, "5": 192}


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(200, 300), (300, 250), (7, 7)]
    edges += [(rnd.randrange(400, 480), rnd.randrange(400, 480)) for _ in range(60)]
    head = {x: x for e in edges for x in e}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        head[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert all(got[x] == root(x) for x in got) and {x for e in edges if e[0] != e[1] for x in e} == set(got)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "decontamination", "mixing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA)
        if name != "mixing":
            assert after.columns == docs.columns
        after = spark.createDataFrame(after.toPandas(), after.schema)
        n, m = before.count(), after.count()
        assert 0 < m <= n if name != "suffix_dedup" else m == n
        if name == "jaccard_join":
            lead = registry.QUERIES["op9_jaccard_join"]
            assert lead is not None and after.select("doc_id").distinct().count() == m
        before = after
    assert {"epoch", "domain", "budget"} <= set(before.columns)


def test_pipeline_on_messy_and_empty_tables(spark, frame, messy):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for pairs in (messy, []):
        docs = frame(pairs).select(*columns)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            if name != "mixing":
                assert docs.columns == columns


def test_nothing_else_imports_this_package():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(top, "geoping")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "geoping.llm" not in source.read()
