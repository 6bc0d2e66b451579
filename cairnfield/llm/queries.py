"""Queries of this subpackage: name -> (session, folder) -> result; and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnfield.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from cairnfield.llm import credentials, functions, language, leaks, pieces, pii, provenance, syntax, tokens

    return {
        "p1_found": lambda s, d: credentials.found_lines(table(s, d, "repository_files")),
        "p1_redacted": lambda s, d: credentials.redacted_files(table(s, d, "repository_files")),
        "p2_found": lambda s, d: functions.documented_symbols(table(s, d, "repository_files"), table(s, d, "repository_file_symbols")),
        "p2_pairs": lambda s, d: functions.code_description_pairs(table(s, d, "repository_files"), table(s, d, "repository_file_symbols")),
        "p3_found": lambda s, d: pii.found_items(table(s, d, "notes")),
        "p3_masked": lambda s, d: pii.masked_notes(table(s, d, "notes")),
        "p4_found": lambda s, d: provenance.not_handwritten(table(s, d, "repository_files")),
        "p4_labels": lambda s, d: provenance.labelled_files(table(s, d, "repository_files")),
        "p5_found": lambda s, d: syntax.invalid_files(table(s, d, "repository_files")),
        "p5_rates": lambda s, d: syntax.invalid_rates(table(s, d, "repository_files")),
        "p6_found": lambda s, d: pieces.oversized_items(table(s, d, "notes"), table(s, d, "repository_files")),
        "p6_pieces": lambda s, d: pieces.split_items(table(s, d, "notes"), table(s, d, "repository_files")),
        "p8_ids": lambda s, d: tokens.encode_documents(table(s, d, "documents")),
        "p9_found": lambda s, d: leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
        "p9_spans": lambda s, d: leaks.leaked_spans(table(s, d, "documents"), table(s, d, "eval_items")),
        "p10_found": lambda s, d: language.unnamed_languages(table(s, d, "documents")),
        "p10_passages": lambda s, d: language.passages(table(s, d, "documents")),
        "p10_documents": lambda s, d: language.document_languages(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
            select 'notes' as item_table, id as item_id from notes where length(body) > 6000
            union select 'repository_files', id from repository_files where length(content) > 6000""",
        "p9_found": r"""
            with doc as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from (select distinct doc_id, text from documents)),
            item as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from (select distinct item_id, text from eval_items)),
            runs as (select doc_id, array_to_string(w[n : n + 12], ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 11)) as n from doc)),
            wanted as (select item_id, array_to_string(w[n : n + 12], ' ') as run from (select item_id, w, unnest(range(1, len(w) - 11)) as n from item))
            select distinct doc_id, item_id from runs join wanted using (run)""",
    }
