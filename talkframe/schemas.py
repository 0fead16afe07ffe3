"""Tables of a dictation service, as Spark schemas.

Times are timestamps in UTC and flags are booleans; lists that a row store would keep as JSON
text are arrays. ``defaults`` fills what an insert leaves out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DDL = {
    "transcriptions": "id long, created_at timestamp, text string, raw_text string, corrected boolean, language string, duration double, mode string, user_id string, tenant_id string, processing_ms int, whisper_model string",
    "snippets": "id long, tenant_id string, user_id string, trigger_phrase string, expansion string, scope string",
    "user_dictionary": "id long, tenant_id string, user_id string, trigger string, replacement string, scope string",
    "users": "id string, email string, password_hash string, tenant_id string, role string, is_active boolean, created_at timestamp",
    "audit_log": "id long, tenant_id string, user_id string, action string, target string, created_at timestamp",
    "correction_feedback": "id long, tenant_id string, user_id string, raw_whisper string, model_output string, user_action string, user_edit string, app_context string, window_title string, mode string, language string, created_at timestamp",
    "symbol_index": "id long, tenant_id string, user_id string, project_path string, file_path string, symbol_type string, symbol_name string, line_number int",
    "symbol_index_v2": "id long, tenant_id string, user_id string, project_path string, file_path string, symbol_type string, symbol_name string, line_number int, end_line int, signature string, parent_symbol string, parent_class string, conformances string, return_type string, properties array<struct<text:string>>, imports array<string>, decorators array<string>, visibility string, is_static boolean, indexed_at timestamp",
    "training_sentences": "id long, tenant_id string, training_set string, persona string, scenario string, text string",
    "training_recordings": "id long, tenant_id string, sentence_id long, training_set string, wav_path string, whisper_out string, duration_ms int, created_at timestamp",
    "config": "key string, value string",
    "token_blacklist": "jti string, expires_at timestamp, revoked_at timestamp",
}

PAIR = "input string, output string, category string, type string, difficulty string, source string"


def schema(name: str) -> StructType:
    """A table's schema; a session must be active, as DDL is parsed by Spark."""
    return StructType.fromDDL(DDL[name])


def defaults(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with all columns of the table, in its order; a missing tenant is ``default``."""
    have = {c.lower(): c for c in rows.columns}
    columns = []
    for f in schema(name).fields:
        c = F.col(have[f.name]) if f.name in have else F.lit(None)
        if f.name == "tenant_id":
            c = F.coalesce(c, F.lit("default"))
        columns.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; a column that one side lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True)
