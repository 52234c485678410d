"""Names shared by all modules: levels, methods, states, schemas."""

from __future__ import annotations

# ---- fixed values: stored codes
METHOD_RULE, METHOD_MODEL, METHOD_NONE = "regla", "ia", "no_encontrado"
METHOD_RECIPE, METHOD_FIXED, METHOD_DERIVED = "extractor_dedicado", "valor_fijo", "derivado"
HIGH, MEDIUM, LOW, NO_DATA = "alta", "media", "baja", "sin_datos"
PENDING, CLASSIFIED, NEEDS_PERSON = "pendiente", "clasificado", "requiere_manual"
CONFIRMED, SENT, FAILED = "confirmado", "enviado", "error"
DETECTED_BY_PATTERNS, DETECTED_BY_KEYWORDS, DETECTED_BY_HAND = "patrones", "keywords", "manual"
VEHICLE_GROUP = "vehiculos"

PATTERN_POINTS, KEYWORD_POINTS = 3, 1
HIGH_TOTAL, MEDIUM_TOTAL = 9, 3
MODEL_HIGH, MODEL_MEDIUM = 0.85, 0.60
HISTORY_CHARS, TRAINING_CHARS, LABEL_CHARS = 50_000, 80_000, 1_000
REQUEST_CHARS, PATTERN_REQUEST_CHARS, EXAMPLE_CHARS = 2_500, 3_000, 600
FILES_PER_REQUEST, MAX_FILE_MB = 50, 15
RETENTION_DAYS, RETENTION_CAP = 7, 500
BATCH_TTL_MINUTES = 25
LITERAL_CONTEXT, LABEL_CONTEXT = 300, 350
# ---- end of fixed values

COMPANY, LINE, PRODUCT = "company", "line", "product"

# priority of the source of a value: the lowest rank wins
RANK_RECIPE, RANK_RULE, RANK_FIXED, RANK_MODEL, RANK_MISSING = 0, 1, 2, 3, 9

CATALOGUE_SCHEMA = (
    "level string, id bigint, parent_id bigint, name string, alias string, "
    "keywords array<string>, patterns array<string>, active boolean, priority int"
)
RULE_SCHEMA = (
    "rule_id bigint, product_id bigint, field string, pattern string, active boolean, draft boolean, "
    "bbox struct<page:int,x0:double,top:double,x1:double,bottom:double>"
)
FIELD_TYPE = "struct<field:string,value:string,method:string,rule_id:bigint>"
SPAN_TYPE = (
    "struct<page:int,ord:int,block:int,line:int,text:string,x0:double,y0:double,x1:double,y1:double,"
    "page_width:double,page_height:double>"
)
