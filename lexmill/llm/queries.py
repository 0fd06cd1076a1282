"""Registered queries of the training-data operators; each runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, lookalike, mojibake, neardup, packing, residue, scans, split
from lexmill.session import ship, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks above the limit of their config."""
    return split.oversized(table(spark, folder, "chunks"), table(spark, folder, "configs"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces that replace the chunks above their limit."""
    return split.split_chunks(table(spark, folder, "chunks"), table(spark, folder, "configs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Results of which a part was decoded wrongly."""
    return mojibake.repair(table(spark, folder, "conversion_results"), table(spark, folder, "documents")).select("result_id")


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The same results with the restored text, null where something is lost, and the encodings that were mixed up."""
    return mojibake.repair(table(spark, folder, "conversion_results"), table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows whose texts look the same but are different strings."""
    return lookalike.alike_pairs(table(spark, folder, "chunks"), table(spark, folder, "conversion_results"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that looks like a different string: its group and its class of equal strings."""
    return lookalike.alike_groups(table(spark, folder, "chunks"), table(spark, folder, "conversion_results"))


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every text."""
    texts = lookalike.texts_of(table(spark, folder, "chunks"), table(spark, folder, "conversion_results"))
    return lookalike.consistent(texts, pairs=lookalike.letter_pairs(texts)).select("tbl", "id", "form")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Scans and the defects of their texts."""
    return scans.find_defects(table(spark, folder, "conversion_results"), table(spark, folder, "cross_checks"))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of scans as continuous paragraphs."""
    return scans.repair(table(spark, folder, "conversion_results"), table(spark, folder, "cross_checks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows above the threshold of similarity."""
    return neardup.similar_pairs(table(spark, folder, "chunks"), table(spark, folder, "conversion_results"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that is similar to another: its group, its class of equal texts and the number of links of the class."""
    return neardup.similar_groups(table(spark, folder, "chunks"), table(spark, folder, "conversion_results"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, folder, "documents"))


def _packed(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return packing.pack(table(spark, folder, "documents"), packing.capacity_of(table(spark, folder, "containers"), name))

    query.__name__ = f"p7_{name}"
    query.__doc__ = f"Documents in containers of the kind {name!r}."
    return query


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of the kind 'standard'."""
    return _packed("standard")(spark, folder)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with residue."""
    documents = table(spark, folder, "documents")
    return documents.filter(residue.has_residue(documents["text"])).select("doc_id")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that remain when those with residue are excluded."""
    return residue.exclude_residue(table(spark, folder, "documents")).select("doc_id", "lang", "source", "n_chars")


def p8_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with residue and the kinds of it."""
    return residue.find_residue(table(spark, folder, "documents")).select("doc_id", "residue")


_ALL = (p1_found, p1_pieces, p2_found, p2_restored, p3_found, p3_groups, p3_forms, p4_found, p4_repaired, p5_found, p5_groups, p6_ids, p7_packed, *(_packed(n) for n in ("short", "long", "extra")), p8_found, p8_kept, p8_kinds)


def queries() -> dict:
    def shipped(run):
        def query(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return run(spark, folder)

        query.__doc__ = run.__doc__
        return query

    return {run.__name__: shipped(run) for run in _ALL}


def oracle_sql() -> dict[str, str]:
    """None: these operators have no SQL of the same result; tests/llm holds them against brute force."""
    return {}
