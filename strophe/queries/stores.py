"""Queries over what the library itself has written from the tables: commits over several tables, recorded pages."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from strophe.ledger import Ledger
from strophe.lineage import shared_dir
from strophe.operators.numbering import number
from strophe.queries.views import table
from strophe.registry import query
from strophe.sources.paged import paged_source

CHAPTERS = "o AS (SELECT o_orderkey, o_orderpriority AS book, CAST(o_custkey % 10 AS INT) AS chapter, o_totalprice FROM orders), touched AS (SELECT * FROM o WHERE book = '1-URGENT' AND chapter < 3)"


@query(f"""WITH {CHAPTERS}, t AS (SELECT * FROM o WHERE NOT (book = '1-URGENT' AND chapter < 4) UNION ALL SELECT o_orderkey, book, chapter, o_totalprice + 1 FROM touched WHERE o_orderkey % 2 = 0),
tags AS (SELECT book, chapter, CASE WHEN book = '1-URGENT' AND chapter < 3 THEN 'new' ELSE 'old' END AS tag FROM (SELECT DISTINCT book, chapter FROM o))
SELECT tags.book, tags.chapter, tags.tag, count(t.o_orderkey) AS n, round(coalesce(sum(t.o_totalprice), 0), 2) AS total FROM tags LEFT JOIN t ON t.book = tags.book AND t.chapter = tags.chapter GROUP BY ALL""")
def chapter_replace(spark, d):
    """Chapters deleted and inserted again in two tables by one commit; one chapter only goes."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("book"), (F.col("o_custkey") % 10).cast("int").alias("chapter"), "o_totalprice")
    ledger = Ledger(spark, f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    first = ledger.begin()
    first.replace("lines", o, ["book", "chapter"])
    first.replace("tags", o.select("book", "chapter").distinct().withColumn("tag", F.lit("old")), ["book"])
    first.commit()

    def again(change):
        held = change.read("lines").filter("book = '1-URGENT' and chapter < 3")
        change.replace("lines", held.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["book", "chapter"], clear=[("1-URGENT", c) for c in range(4)])
        tags = change.read("tags").filter("book = '1-URGENT'")
        change.replace("tags", tags.withColumn("tag", F.when(F.col("chapter") < 3, "new").otherwise(F.col("tag"))), ["book"])

    ledger.run(again)
    both = ledger.read("tags").join(ledger.read("lines"), ["book", "chapter"], "left")
    return both.groupBy("book", "chapter", "tag").agg(F.count("o_orderkey").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def catalog_pages(spark, d):
    """Customers recorded as pages of 50, read by the paginated source."""
    c = number(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_custkey"], "at", start=0)
    total = c.agg(F.greatest(F.ceil(F.count("*") / 50), F.lit(1)).alias("total_pages"))
    pages = c.groupBy(F.expr("at div 50 + 1").alias("current_page")).agg(F.collect_list(F.struct("c_custkey", "c_nationkey", "c_acctbal")).alias("data")).crossJoin(F.broadcast(total))
    text = F.to_json(F.struct("data", F.struct(F.struct("current_page", "total_pages").alias("pagination")).alias("meta")))
    folder = f"{shared_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    folder = folder if ":" in folder else f"file://{folder}"

    def record(batches):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        for batch in batches:
            for i, t in zip(batch.column("current_page").to_pylist(), batch.column("text").to_pylist(), strict=True):
                with files.open_output_stream(f"{path}/page-{i}.json") as out:
                    out.write(t.encode())
            yield pa.RecordBatch.from_arrays([batch.column("current_page")], names=["page"])

    pages.select("current_page", text.alias("text")).mapInArrow(record, "page long").count()
    spark.dataSource.register(paged_source("recorded_pages"))
    return spark.read.format("recorded_pages").schema("c_custkey long, c_nationkey int, c_acctbal double").load(folder)
