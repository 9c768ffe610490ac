"""Explicit schemas of the tables that the engine reads and writes."""

from pyspark.sql import types as T

_s, _l = T.StringType(), T.LongType()


def _table(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW = _table(src_fm_fc_ms_ff=_s, target=_s)
PROFILE_RAW = _table(src_fm_fc_ms=_s, target=_s)
PROCESSED = _table(prompt=_s, idx=_l)
INFERENCE = _table(prompt=_s, reference=_s)
_ids = T.ArrayType(T.IntegerType())
TOKENIZED = _table(input_ids=_ids, attention_mask=_ids, labels=_ids)
TOKENIZED_INFER = _table(input_ids=_ids, attention_mask=_ids)
PREDICTIONS = _table(prediction=_s, original_idx=_l)
COMPILED = _table(idx=_l, status=_s, fixed_src=_s, log=_s)
COMPILE_ERRORS = _table(idx=_l, error=_s)
COVERAGE = _table(original_idx=_l, coverage=T.DoubleType())
IMPORT = _table(is_static=T.BooleanType(), fqcn=_s, is_wildcard=T.BooleanType())
MESSAGE = _table(role=_s, content=_s)
METRIC = _table(metric=_s, score=T.DoubleType(), passed=_l, n_in=_l, pct_total=T.DoubleType(), error=_s)
COUNTER = _table(_type=_s, _missed=_l, _covered=_l)
METHOD = _table(_name=_s, _desc=_s, counter=T.ArrayType(COUNTER))
STATUSES = ("HARD_PASS", "SOFT_PASS", "HARD_FAIL")


def require(df, schema: T.StructType, what: str):
    """df, or a ValueError that names the columns it lacks; missing is found before any job runs."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df
