"""The query of each operator of this subpackage, and its DuckDB equivalent where there is one."""

from citegrain.llm import chat_format, decontamination, language_id, line_templates, media, packing, sharding, simhash, substring_dedup, url_filters

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_media": media.op4_media,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_packing": packing.op6_packing,
    "op7_simhash": simhash.op7_simhash,
    "op8_line_templates": line_templates.op8_line_templates,
    "op9_sharding": sharding.op9_sharding,
    "op10_url_filters": url_filters.op10_url_filters,
}
ORACLE_SQL = {
    "op2_chat_format": chat_format.OP2_SQL,
    "op8_line_templates": line_templates.OP8_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
}
