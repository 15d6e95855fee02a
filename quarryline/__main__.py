"""Command line: ``parse`` files to JSON, ``ingest`` documents to chunks and an index, ``query`` them with questions."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from quarryline.operators import retrieval
from quarryline.plans.answer import answer, ingest
from quarryline.session import build_session
from quarryline.sources import files, parsers, store


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(prog="quarryline", description=__doc__)
    cli.add_argument("--cores", type=int, help="run locally on so many cores; on a cluster, leave it out")
    todo = cli.add_subparsers(dest="todo", required=True)
    parse = todo.add_parser("parse", help="text of supported files, as JSON lines")
    parse.add_argument("paths", nargs="+")
    parse.add_argument("--recursive", action="store_true")
    parse.add_argument("--parser", help="one parser for all files; by default each kind of file has its own, and what has none is set apart")
    take = todo.add_parser("ingest", help="chunks of a table of documents (doc_id, text, source) and their index")
    take.add_argument("documents")
    ask = todo.add_parser("query", help="answers to a table of questions (question_id, question)")
    ask.add_argument("questions")
    ask.add_argument("--store", required=True, help="what ingest wrote")
    for command in (parse, take, ask):
        command.add_argument("--out", required=True)
    said = cli.parse_args(argv)
    spark = build_session("quarryline", cores=said.cores)
    if said.todo == "parse":
        found = files.scan_files(spark, said.paths, said.recursive)
        store.dump_json(parsers.parse_files(found, said.parser) if said.parser else parsers.parse_by_type(found), said.out)
    elif said.todo == "ingest":
        docs = spark.read.parquet(said.documents)
        store.dump_ingest(ingest(docs), None, said.out, documents=docs.select(F.col("doc_id").cast("string").alias("doc_id")))
        retrieval.bootstrap_index(spark.read.parquet(f"{said.out}/chunks"), f"{said.out}/index", key="point_id")
    else:
        chunks = spark.read.parquet(f"{said.store}/chunks").select(F.col("point_id").alias("chunk_id"), "text", F.col("source_file").alias("source"), F.col("chunk_index").cast("string").alias("section"))
        index, _ = retrieval.bootstrap_index(chunks, f"{said.store}/index", key="chunk_id")
        answer(spark.read.parquet(said.questions), chunks, index).write.mode("overwrite").parquet(said.out)


if __name__ == "__main__":
    main()
