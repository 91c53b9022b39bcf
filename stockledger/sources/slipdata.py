"""Bridge P: packing-slip answers derived from ``orders`` and ``lineitem``.

One slip per order; its lines are the order's line items (item PART-<partkey>,
quantity, confidence from the return flag: N high, A absent (-> default),
R low, or an unknown value on undiscounted R lines, which voids the slip).
The answer text is JSON written by ``to_json``, wrapped in four ways (bare,
```json fence, ``` fence, prose + fence).  Orders with certain remainders also
get a damaged or unusual copy of their answer under the negative id
(``COPIES``), so those paths are exercised on real volume; every order's own
text stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.sources.bridge import read_table


# remainder of the order number by 25 -> the copy's text from the whole answer __j
COPIES = {
    7: "substring(__j, 1, length(__j) - 2)",                                            # cut short
    8: "concat(__j, ' x')",                                                             # text behind the answer
    9: "replace(__j, '\"item_id\":\"PART-', '\"item_id\":\"') || ''",                    # ids without prefix: still texts
    10: "replace(__j, '\"confidence\":\"high\"', '\"confidence\":null')",               # null is no confidence
    11: "'{\"items\":null}'",                                                           # null is no list
    12: "concat('```json\n', __j, '\n```\nor\n```json\n{}\n```')",                      # the first block counts
    13: "concat('{\"vendor\":5,', substring(__j, 2))",                                  # numeric vendor
    14: "regexp_replace(__j, '\"qty\":([0-9]+)', '\"qty\":\"+$1\"')",                   # numeric text
    15: "regexp_replace(__j, '\"item_id\":\"[^\"]*\"', '\"item_id\":\"\u00a0 \"')",    # blank ids, dropped at submission
    16: "regexp_replace(__j, '\"item_id\":\"PART-([0-9]+)\"', '\"item_id\":$1')",       # numeric ids
}


def slip_line_source(lineitem: DataFrame) -> DataFrame:
    conf = (F.when(F.col("l_returnflag") == "N", F.lit("high"))
            .when(F.col("l_returnflag") == "A", F.lit(None).cast("string"))
            .when(F.col("l_discount") == 0.0, F.lit("unsure"))
            .otherwise(F.lit("low")))
    return lineitem.select(
        F.col("l_orderkey").alias("slip_id"),
        F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"),
                 F.col("l_extendedprice")).alias("__ord"),
        F.concat(F.lit("PART-"), F.col("l_partkey").cast("string")).alias("item_id"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("description"),
        conf.alias("confidence"))


def slip_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = slip_line_source(read_table(spark, sf_dir, "lineitem"))
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("slip_id"),
        F.concat(F.lit("PO-"), F.col("o_orderkey").cast("string")).alias("po_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ship_date"))
    grouped = li.groupBy("slip_id").agg(
        F.array_sort(F.collect_list(F.struct("__ord", "item_id", "qty", "description", "confidence")))
        .alias("__lines"))
    doc = grouped.join(orders, "slip_id", "inner").select(
        "slip_id",
        F.to_json(F.struct(
            F.transform("__lines", lambda x: F.struct(x["item_id"].alias("item_id"), x["qty"].alias("qty"),
                                                      x["description"].alias("description"),
                                                      x["confidence"].alias("confidence"))).alias("items"),
            F.col("po_number"), F.col("ship_date"))).alias("__j"))
    j = F.col("__j")
    k = F.col("slip_id") % 4
    text = (F.when(k == 0, j)
            .when(k == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("```\n"), j, F.lit("\n```")))
            .otherwise(F.concat(F.lit("Extracted items:\n```json\n"), j, F.lit("\n```\nDone."))))
    copy = F.lit(None).cast("string")
    for n, t in COPIES.items():     # only the row's own copy is built
        copy = F.when(F.col("slip_id") % 25 == n, F.expr(t)).otherwise(copy)
    both = F.array(F.struct(F.col("slip_id"), text.alias("response")), F.struct((-F.col("slip_id")).alias("slip_id"), copy.alias("response")))
    return doc.select(F.explode(both).alias("x")).select("x.*").where("response is not null")


# the endings that the slip files of the customers take in turn; the last has none
ENDINGS = (".jpg", ".JPEG", ".png", ".webp", ".gif", ".PDF", ".tif", ".txt", "")

# sub-folders that the slip files are dealt into
FOLDERS = 64


def slip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, content): one file per customer, a line for each of the customer's orders."""
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("o_custkey") % len(ENDINGS)).cast("int") + 1)
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(line)).alias("l")).select(
        F.concat(F.lit("slip-"), F.col("o_custkey").cast("string"), ending).alias("name"), F.array_join("l", "\n").cast("binary").alias("content"))


def write_files(files: DataFrame, root: str) -> int:
    """Write each row's ``content`` to the file ``name`` in a sub-folder of ``root``, by the tasks that hold the rows; returns their number.

    The sub-folder follows from the name: Spark lists folders in parallel, but the files of one folder one by one.
    A file is written whole under its own name, so a task that runs again repeats nothing.
    """
    root = re.sub(r"^file:/+", "file:///", root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for folder in range(FOLDERS):
            store.create_dir(f"{base}/folder={folder}", recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                with store.open_output_stream(f"{base}/folder={crc32(str(name).encode()) % FOLDERS}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
