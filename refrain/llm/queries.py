"""Queries of the operators in this subpackage, by name. SQL can express none of them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refrain.llm import genre_list, leaks, lookalikes, mojibake, name_variants, packing, recording_links, residue


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each takes (session, folder of tables)."""
    return {
        "p1_found": genre_list.found,
        "p1_values": genre_list.mapping_report,
        "p2_found": mojibake.found,
        "p2_restored": mojibake.restored,
        "p3_found": recording_links.found,
        "p3_links": recording_links.scored,
        "p6_found": name_variants.found,
        "p6_entities": name_variants.classes,
        "p7_found": lookalikes.found,
        "p7_forms": lookalikes.forms,
        "p7_groups": lookalikes.groups,
        "p8_windows": packing.assignment,
        "p8_fill": packing.summary,
        "p9_found": leaks.found,
        "p9_items": leaks.leaked_items,
        "p10_found": residue.found,
        "p10_messages": residue.report,
    }


def oracle_sql() -> dict[str, str]:
    """SQL by query; empty, as edit distances over whole tables, searches and packings are too slow or not expressible in it."""
    return {}
