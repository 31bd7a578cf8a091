"""Message text to typed record, with the coercions of a lenient JSON reader."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillstream.functions.arrays import bind
from quillstream.functions.text import clean_list, is_blank, normalize_text
from quillstream.schemas import LIST_FIELDS, PAPER_EVENT

# Strict JSON: no single quotes, no NaN.
_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
_CORRUPT = "_corrupt"
_RAW_SCHEMA = ", ".join(
    f"`{f.name}` {'array<string>' if f.name in LIST_FIELDS else 'string'}" for f in PAPER_EVENT.fields
) + f", `{_CORRUPT}` string"
_RAW_OPTIONS = {**_JSON_OPTIONS, "columnNameOfCorruptRecord": _CORRUPT}


def raw_fields(value: Column) -> Column:
    """``fields``: scalars as text (anything nested as its JSON text) and lists of
    such texts; null for a root array, which holds no fields. ``nested``: whether
    a list might hold lists or objects.

    The corrupt field is set when the text is no JSON or a list field holds
    something else.
    """
    fields = F.from_json(F.when(~F.startswith(F.ltrim(value), F.lit("[")), value), _RAW_SCHEMA, _RAW_OPTIONS)
    nested = F.coalesce(value.rlike(r"[\[,]\s*[\[{]"), F.lit(False))
    return F.struct(fields.alias("fields"), nested.alias("nested"))


def _looks_nested(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit("{")) | F.startswith(text, F.lit("[")), F.lit(False))


def _variant_kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path, "variant"))


def text_field(value: Column, raw: Column, name: str) -> Column:
    """Scalar text; missing, null, object and array become ''.

    Only a text that looks like an object or array needs the type test, so the
    second parse runs on those rows alone.
    """
    field = raw["fields"][name]
    nested = F.coalesce(_variant_kind(value, f"$.{name}").rlike("^(OBJECT|ARRAY)"), F.lit(False))
    return F.when(field.isNull() | (_looks_nested(field) & nested), "").otherwise(field)


def int_field(value: Column, raw: Column, name: str) -> Column:
    """Whole number of a JSON number, numeric text or boolean; else 0."""
    field = F.btrim(raw["fields"][name])
    wide = F.coalesce(
        field.try_cast("bigint"),
        F.when(field.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), field.try_cast("double").try_cast("bigint")),
    )
    boolean = (field == "true") & (_variant_kind(value, f"$.{name}") == "BOOLEAN")
    # Keep the low 32 bits, as a narrowing conversion does.
    narrowed = F.shiftright(F.shiftleft(wide, 32), 32).cast("int")
    return F.when(field.isNull(), 0).when(boolean, 1).otherwise(F.coalesce(narrowed, F.lit(0)))


def list_field(value: Column, raw: Column, name: str) -> Column:
    """Cleaned list; anything but an array gives []. Nested items are dropped.

    Only rows with the corrupt mark, or with items that look nested, are parsed
    a second time.
    """

    def field_text() -> Column:
        return F.from_json(value, f"`{name}` string", _JSON_OPTIONS)[name]

    def recovered() -> Column:
        return bind(field_text(), lambda t: F.from_json(F.when(F.startswith(t, F.lit("[")), t), "array<string>", _JSON_OPTIONS))

    def scalars(items: Column) -> Column:
        typed = F.try_variant_get(F.try_parse_json(field_text()), "$", "array<variant>")
        kept = F.filter(typed, lambda v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))
        texts = F.transform(kept, lambda v: F.try_variant_get(v, "$", "string"))
        return F.when(F.exists(items, _looks_nested), texts).otherwise(items)

    fields = raw["fields"]
    sound = fields[_CORRUPT].isNull()
    items = F.when(sound, fields[name]).otherwise(F.when(fields.isNotNull(), recovered()))
    return clean_list(F.when(sound & ~raw["nested"], fields[name]).otherwise(bind(items, scalars)))


def malformed(value: Column, raw: Column) -> Column:
    """True for text no JSON reader accepts. Blank text and other JSON roots are not malformed."""
    suspect = raw["fields"].isNull() | raw["fields"][_CORRUPT].isNotNull()
    return suspect & ~is_blank(value) & F.try_parse_json(value).isNull()


def event_columns(value: Column, raw: Column) -> list[Column]:
    """The typed record as columns, given the parsed ``raw`` struct."""
    columns = []
    for field in PAPER_EVENT.fields:
        if field.name in LIST_FIELDS:
            column = list_field(value, raw, field.name)
        elif field.name == "year":
            column = int_field(value, raw, field.name)
        else:
            column = text_field(value, raw, field.name)
            if field.name in ("title", "abstract"):
                column = normalize_text(column)
        columns.append(column.alias(field.name))
    return columns
