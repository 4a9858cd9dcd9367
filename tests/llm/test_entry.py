"""The eleven queries are registered, and give the columns that are asked for."""

import re

import __spark_entry__ as entry
from tests.conftest import SMALL

COLUMNS = {
    2: "page_id host path rule verdict", 3: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 4: "vec_id n_links component_id kept", 5: "doc_id n_shingles component_id kept",
    6: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 7: "doc_id n_words n_removed kept_sha256", 8: "doc_id held_out lang_pred score",
    9: "doc_id held_out score predicted", 10: "doc_id n_assign n_access n_hex base_sha256 spans",
}


#: what the contracts name, of these types; other columns may follow
TYPES = {
    "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint", "n_links": "bigint", "component_id": "bigint",
    "kept": "boolean", "n_shingles": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean",
    "n_removed": "bigint", "kept_sha256": "string", "held_out": "boolean", "lang_pred": "string", "score": "double", "predicted": "int", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint",
    "base_sha256": "string", "spans": "string", "host": "string", "path": "string", "rule": "string", "verdict": "string", "doc_id": "bigint", "page_id": "bigint", "vec_id": "bigint",
}


def test_registration(spark):
    found = entry.queries()
    numbers = {int(m[1]): n for n in found if (m := re.match(r"op(\d+)_", n))}
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in found
    for k in range(2, 11):
        told = dict(found[numbers[k]](spark, SMALL).dtypes)
        assert set(COLUMNS[k].split()) <= set(told), k
        assert all(told[c] == TYPES[c] for c in COLUMNS[k].split()), (k, told)
