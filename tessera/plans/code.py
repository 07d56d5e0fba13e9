"""Queries of the code family: chunks, symbols, imports, graphs, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import code as C
from tessera.plans.fixture import Fixture, ctes, spread

_TS = """import { a, b as c } from './util.js';
import Base from '../core/base';
import * as path from 'path';
const fs = require('fs');

/** doc */
export class Store extends Base {
  private n = 0;
  constructor(x) {
    if (x > 1 && x < 5) { this.n = x; }
  }
  async load(id) {
    for (const k of id) {
      if (k || a(k)) { while (k) { c(k); } }
    }
    return id ? 1 : 2;
  }
}

export const run = async (q) => {
  switch (q) {
    case 1: return a(q) ?? b(q);
  }
};
type Id = string;
// function hidden() {}
export function tail() { return 1; }
"""
_PY = "from os import path as p, sep\nimport json as j\n\nclass A:\n    def f(self):\n        if (x):\n            pass\n\n    async def g(self):\n        return 1\n\ndef h():\n    return json(1)\n"
_GO = 'package x\nimport (\n\t"fmt"\n\tio "x/ioutil"\n)\ntype T struct {\n}\nfunc (t *T) Run() {\n}\n'
_LONG = "\n".join(f"line {i}" for i in range(30)) + "\nfunction big() {\n" + "\n".join(f"  step({i});" for i in range(170)) + "\n}\n" + "\n".join(f"after {i}" for i in range(25))
FILES = Fixture(
    "files",
    "path string, content string",
    [("src/app/store.ts", _TS), ("src/app/util.ts", "export const a = (x) => x;\nexport function b(x) { return a(x); }\n"), ("src/core/base/index.ts", "export default class Base {}\n"), ("lib/m.py", _PY), ("lib/m.go", _GO), ("src/app/long.js", _LONG), ("src/main.c", "int main() { return f(1); }"), ("src/m.rs", "use std::io::{Read};\npub fn go() {\n}\n"), ("src/M.java", "import java.util.List;\npublic class M {\n  public static void main(String a) {\n  }\n}\n"), ("a.rb", "require 'x/y.rb'\nclass Q\n  def self.z\n  end\nend\n"), ("a.php", "use A\\B;\nfunction k() {\n}\n"), ("E.cs", "using System.Text;\ninternal class E {\n}\n")],
)


def symbol_extract(spark, d):
    return C.symbols(FILES.df(spark)).drop("body")


def symbol_search(spark, d):
    return C.find_symbols(C.symbols(FILES.df(spark)), "a").select("path", "name", "kind", "start_line")


def import_extract(spark, d):
    return C.imports(FILES.df(spark)).withColumn("specifiers", F.array_join("specifiers", ","))


def _edges(spark):
    f = FILES.df(spark)
    return C.import_edges(f, C.imports(f))


def import_edges(spark, d):
    return _edges(spark).withColumn("symbols", F.array_join("symbols", ","))


def graph_stats(spark, d):
    f = FILES.df(spark)
    n = f.agg(F.count("*").alias("files"))
    return n.join(C.imports(f).agg(F.count("*").alias("imports"))).join(C.symbols(f).where("exported").agg(F.count("*").alias("exports")))


def dependents(spark, d):
    return _edges(spark).groupBy(F.col("to").alias("path")).agg(F.count("*").alias("dependents"))


def related_files(spark, d):
    starts = spark.createDataFrame([("src/app/util.ts",)], "start string")
    return C.neighbours(_edges(spark), starts, 2)


def _pairs(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to")).distinct()


def related_bfs(spark, d):
    """Suppliers and parts within two steps of five suppliers, over all orders."""
    starts = spark.createDataFrame([(f"s{i}",) for i in range(1, 6)], "start string")
    return C.neighbours(_pairs(spark, d), starts, 2)


def call_site_counts(spark, d):
    return C.call_sites(FILES.df(spark))


def symbol_usage(spark, d):
    return C.call_sites(FILES.df(spark)).where("symbol = 'a'").select("path", "calls")


def code_metrics(spark, d):
    return C.function_metrics(C.symbols(FILES.df(spark))).drop("ord")


def code_health(spark, d):
    return C.health(C.function_metrics(C.symbols(FILES.df(spark))))


BODIES = Fixture("bodies", "id int, body string", [(0, "if (a && b) { x ? y : z }\n// if (a)\nelse if (c) {{ }}"), (1, ""), (2, "while(x){for(;;){try{}catch(e){}}}\ncase 1:\n a ?? b || c"), (3, "}}{{")])


def complexity_of(spark, d):
    return BODIES.df(spark).select("id", C.complexity(F.col("body")).alias("complexity"))


def nesting_of(spark, d):
    return BODIES.df(spark).select("id", C.nesting(F.col("body")).alias("nesting"))


def definition_chunks(spark, d):
    return C.definition_chunks(FILES.df(spark)).select("id", "path", "start_line", "end_line", F.md5("content").alias("md5"))


def hierarchical_chunks(spark, d):
    return C.hierarchical_chunks(FILES.df(spark)).select("id", "path", "start_line", "end_line", "type", "level", "symbol_name")


def document_chunks(spark, d):
    """Definition chunks of all documents."""
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))
    return C.definition_chunks(docs).select("id", "start_line", "end_line", F.length("content").alias("chars"))


def fixed_chunks(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return C.fixed_chunks(docs).select(F.col("path").alias("doc_id"), "start_line", "end_line", F.md5("content").alias("md5"))


QUERIES = {f.__name__: f for f in (
    symbol_extract, symbol_search, import_extract, import_edges, graph_stats, dependents, related_files, related_bfs, call_site_counts, symbol_usage, code_metrics, code_health,
    complexity_of, nesting_of, definition_chunks, hierarchical_chunks, document_chunks, fixed_chunks,
)}
_CALLS = rf"SELECT path, s AS symbol, count(*) AS calls FROM (SELECT path, unnest(regexp_extract_all(content, '{C.CALL}', 1)) AS s FROM files) WHERE s NOT IN ({', '.join(repr(x) for x in C.NO_CALLS)}) GROUP BY ALL"
_HITS = " + ".join(f"regexp_matches(x, '{p}')::INT" for p in C.DECISIONS)
ORACLES = {
    "related_bfs": """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 's' || i AS start, 's' || i AS node, 0 AS distance FROM range(1, 6) t(i) UNION SELECT start, b, distance + 1 FROM r JOIN u ON node = a WHERE distance < 2)
SELECT start, node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY start, node HAVING min(distance) > 0""",
    "call_site_counts": ctes(FILES) + f" {_CALLS}",
    "symbol_usage": ctes(FILES) + f" SELECT path, calls FROM ({_CALLS}) WHERE symbol = 'a'",
    "complexity_of": ctes(BODIES) + f", l AS (SELECT id, trim(unnest(string_split(body, chr(10)))) AS x FROM bodies) SELECT id, CAST(1 + sum(CASE WHEN regexp_matches(x, '^(//|\\*|#)') THEN 0 ELSE {_HITS} END) AS INTEGER) AS complexity FROM l GROUP BY id",
    "fixed_chunks": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1, 50)) AS i FROM l) SELECT doc_id, CAST(i AS INTEGER) AS start_line, CAST(least(i + 49, len(ls)) AS INTEGER) AS end_line, md5(array_to_string(ls[i:i + 49], chr(10))) AS md5 FROM s",
}
