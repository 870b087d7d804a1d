"""The command line: python -m seqlattice COMMAND ...

query NAME       runs a registered query and shows it or writes it as Parquet
normalize        a table of texts with its normal forms and the text to embed
embed            vectors of a table's texts, kept where a cache fits
init, check      the tables that a data folder lacks; their keys and columns
import-wiki      the records of a wiki page
export           public records, without texts unless asked for
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import wiki
from .plans.catalogue import QUERIES
from .plans.texts import MODES, normalized_rows, violations
from .sources import embedding, files

#: The tables of a data folder: file, columns, key.
TABLES = {
    "poems": ("poems.csv", ("id", "poet_jp", "poet_kana", "waka_original", "waka_kana", "kami_no_ku", "shimo_no_ku", "source_anthology", "source_book", "source_number", "theme", "season", "notes"), "id"),
    "second_order": ("second_order.csv", ("shuka_order", "hyakunin_id", "poet_jp", "waka_original", "waka_kana", "notes", "variant_group"), "shuka_order"),
    "poets": ("poets.csv", ("hyakunin_id", "poet_jp", "period", "approx_year", "birth_year", "death_year", "status", "gender", "lineage", "notes"), "hyakunin_id"),
}


def rows(spark: SparkSession, path: str):
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else files.read_csv(spark, path, files.header(spark, path))


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    df = QUERIES[args.name](spark, args.data)
    df.write.mode("overwrite").parquet(args.output) if args.output else df.show(50, truncate=80)
    return 0


def normalize(spark: SparkSession, args: argparse.Namespace) -> int:
    files.write_csv(normalized_rows(rows(spark, args.input), args.mode), args.output)
    return 0


def embed(spark: SparkSession, args: argparse.Namespace) -> int:
    source = rows(spark, args.input)
    wanted = normalized_rows(source, args.mode).select(F.col("id").cast("string").alias("id"), F.col("embedding_text").alias("text"))
    if args.dry_run:
        print(f"{wanted.count()} rows, {wanted.where('text = \'\'').count()} without text")
        return 0
    provider = embedding.http_vectors(args.url, args.model, os.environ.get(args.key_variable, "")) if args.url else embedding.local_vectors
    held = None
    if not args.force:
        try:
            held = spark.read.parquet(args.output)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    keyed = wanted.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    if held is not None and embedding.matches(keyed, held.select("id", "sha")):
        print("the cache fits")
        return 0
    held = held if held is not None else spark.createDataFrame([], "id string, sha string, embedding array<double>")
    out = embedding.refreshed(wanted, held, provider, args.batch_size)
    out.write.mode("overwrite").parquet(f"{args.output}.new")  # what is read can't be written over
    spark.read.parquet(f"{args.output}.new").write.mode("overwrite").parquet(args.output)
    return 0


def init(spark: SparkSession, args: argparse.Namespace) -> int:
    for name, columns, _ in TABLES.values():
        print(name, "written" if files.skeleton(spark, f"{args.data}/{name}", list(columns)) else "there")
    return 0


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    failed = 0
    for label, (name, columns, key) in TABLES.items():
        df = files.read_csv(spark, f"{args.data}/{name}", list(columns), lenient=True)
        n, wrong = df.count(), violations(df, label, key, 1, 101).collect()
        print(label, "SCHEMA-ONLY" if not n else "ERROR" if wrong else "OK", n)
        for r in wrong:
            print(f"  {r.rule}: {r.key!r} in {r.n} rows", file=sys.stderr)
        failed += bool(wrong)
    return int(failed > 0)


def import_wiki(spark: SparkSession, args: argparse.Namespace) -> int:
    lines = spark.read.text(args.raw, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    files.write_csv(wiki.records(lines.withColumn("line_no", F.col("line_no").cast("long"))), args.output)
    return 0


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    df = rows(spark, args.input)
    hidden = [c for c in ("waka_original", "waka_kana", "kami_no_ku", "shimo_no_ku", "text") if c in df.columns]
    if not args.include_text:
        df = df.drop(*hidden).withColumn("text_status", F.lit("omitted"))
    cleaned = df.select(*(text.blank_to_null(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    files.write_records(cleaned, args.output)
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="seqlattice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = out.add_subparsers(required=True)

    def command(name: str, run, *needed: str, mode: str = "") -> argparse.ArgumentParser:
        one = sub.add_parser(name)
        one.set_defaults(run=run)
        for option in needed:
            one.add_argument(f"--{option}", required=True)
        if mode:
            one.add_argument("--mode", choices=MODES, default=mode)
        return one

    one = command("query", query, "data")
    one.add_argument("name", choices=sorted(QUERIES))
    one.add_argument("--output")
    command("normalize", normalize, "input", "output", mode="original_tags")
    one = command("embed", embed, "input", "output", mode="original_kana")
    one.add_argument("--model", default="local-64")
    one.add_argument("--url", default="", help="a service that answers with vectors; without it they are made here")
    one.add_argument("--key-variable", default="EMBEDDING_KEY", help="the environment variable that holds the service's key")
    one.add_argument("--batch-size", type=int, default=100)
    one.add_argument("--dry-run", action="store_true")
    one.add_argument("--force", action="store_true", help="ask again for all vectors")
    command("init", init, "data")
    command("check", check, "data")
    command("import-wiki", import_wiki, "raw", "output")
    one = command("export", export, "input", "output")
    either = one.add_mutually_exclusive_group()
    either.add_argument("--include-text", action="store_true")
    either.add_argument("--omit-text", action="store_true", help="the default")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqlattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
