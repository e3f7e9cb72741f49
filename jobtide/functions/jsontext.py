"""JSON documents: payload maps, and field access that can tell text from numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalars import col

TEXT_FIELDS = ("name", "type", "idempotency_key")
NUMBER_FIELDS = ("priority", "max_retries", "timeout_seconds")
_CORRUPT, _READ = "_corrupt", "_read"


def decode_payload(text: str | Column) -> Column:
    """JSON object text to a string map; a null value becomes the empty string."""
    return F.transform_values(F.from_json(col(text), "map<string,string>"), lambda _, v: F.coalesce(v, F.lit("")))


def encode_payload(payload: str | Column = "payload") -> Column:
    return F.to_json(col(payload))


def is_object(text: str | Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(col(text))).startswith("OBJECT"), F.lit(False))


_ENTRIES = "map<string,variant>"


def is_single(text: str | Column) -> Column:
    """The text is one JSON value with nothing behind it: beside a null it makes an array of two."""
    pair = F.from_json(F.concat(F.lit("["), col(text).cast("string"), F.lit(",null]")), "array<string>")
    return F.coalesce(F.size(pair) == 2, F.lit(False))


class Document:
    """A parsed JSON object in a struct column: typed access to its fields, which keep their JSON type."""

    def __init__(self, column: str, texts: tuple[str, ...], numbers: tuple[str, ...], payload: bool):
        self.column, self.texts, self.numbers, self.with_payload = F.col(column), texts, numbers, payload

    def fits(self) -> Column:
        """The document decodes into its fields without any type change. The word ``null`` does, to blanks."""
        verdict = self.column[_READ]
        for field in self.texts:
            verdict = verdict & _kind(self.column[field]).isin("STRING", "VOID")
        for field in self.numbers:
            whole = (_kind(self.column[field]) == "BIGINT") & F.try_variant_get(self.column[field], "$", "int").isNotNull()
            verdict = verdict & (whole | (_kind(self.column[field]) == "VOID"))
        if self.with_payload:
            plain = F.forall(F.map_values(self.column["payload"]), lambda v: _kind(v).isin("STRING", "VOID"))
            verdict = verdict & F.coalesce(plain, F.lit(True))
        return F.coalesce(verdict, F.lit(False))

    def text(self, field: str) -> Column:
        return F.try_variant_get(self.column[field], "$", "string")

    def blank_text(self, field: str) -> Column:
        return F.coalesce(self.text(field), F.lit(""))

    def whole_number(self, field: str) -> Column:
        """The number, NULL where the field is absent or anything else."""
        return F.when(_kind(self.column[field]) == "BIGINT", F.try_variant_get(self.column[field], "$", "bigint"))

    def number(self, field: str) -> Column:
        return F.coalesce(F.when(_kind(self.column[field]) == "BIGINT", F.try_variant_get(self.column[field], "$", "int")), F.lit(0))

    def payload(self) -> Column:
        """String map or NULL. Values that are no text become their JSON text, null the empty string."""
        return F.transform_values(self.column["payload"], lambda _, v: F.coalesce(_as_text(v), F.lit("")))


def _kind(value: Column) -> Column:
    """JSON type name; absent and null both count as VOID."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _as_text(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.when(_kind(value) != "VOID", F.to_json(value)))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` plus columns behind a one-element ``inline``: filters and projections that use them are not pushed
    below it, where each use would compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))


def _last(entries: Column, key: str | Column) -> Column:
    """Value of the last entry with the key."""
    place = F.array_position(F.reverse(F.map_keys(entries)), key)
    return F.get(F.reverse(F.map_values(entries)), (place - 1).cast("int"))


def open_documents(
    df: DataFrame,
    text: str,
    texts: tuple[str, ...] = TEXT_FIELDS,
    numbers: tuple[str, ...] = NUMBER_FIELDS,
    payload: bool = True,
    whole: bool = True,
) -> tuple[DataFrame, Document]:
    """``df`` with its JSON text parsed once per row into ``_doc``, a struct with a value per field.

    Keys match in any case; of the keys that match one field, the last one in the text counts. With ``whole``, text behind
    the document makes it unreadable: the document is parsed as the first of two array elements, and what stands behind
    it would add a third or end the array too early. Where that parse fails, the text is parsed by exact field names, as a
    variant does not hold a payload that names a key twice.
    """
    fields = (*texts, *numbers)
    raw = F.col(text).cast("string")
    if whole:
        pair = F.from_json(F.concat(F.lit("["), raw, F.lit(",null]")), f"array<{_ENTRIES}>")
        first = _once(df, _pair=pair).select(*df.columns, F.when(F.size("_pair") == 2, F.get("_pair", F.lit(0))).alias("_map"))
    else:
        first = _once(df, _map=F.from_json(raw, _ENTRIES))
    unread = F.col("_map").isNull() & (F.trim(raw) != "null")
    schema = [f"`{f}` variant" for f in fields] + ([f"payload {_ENTRIES}"] if payload else []) + [f"{_CORRUPT} string"]
    exact = F.from_json(raw, ", ".join(schema), {"columnNameOfCorruptRecord": _CORRUPT})
    fine = is_single(raw) if whole else F.lit(True)
    second = _once(first, _names=F.transform(F.map_keys("_map"), F.lower), _again=F.when(unread & (raw != ""), F.struct(exact.alias("doc"), fine.alias("fine"))))
    again = F.col("_again.doc")
    good = F.coalesce(F.col("_again.fine") & again[_CORRUPT].isNull(), F.lit(False))
    place = lambda f: (F.array_position(F.reverse("_names"), f) - 1).cast("int")
    found = lambda f: F.get(F.reverse(F.map_values("_map")), place(f))
    values = {f: F.when(good, again[f]).otherwise(found(f)) for f in fields}
    read = F.col("_map").isNotNull() | (F.trim(raw) == "null") | good
    if payload:
        of_variant = F.try_variant_get(found("payload"), "$", _ENTRIES)
        doubled = again["payload"]
        once = F.map_from_entries(F.transform(F.array_distinct(F.map_keys(doubled)), lambda k: F.struct(k, _last(doubled, k))))
        values["payload"] = F.when(good, once).otherwise(of_variant)
        read = read & (good | _kind(found("payload")).startswith("OBJECT") | (_kind(found("payload")) == "VOID"))
    document = F.struct(*[v.alias(f) for f, v in values.items()], F.coalesce(read, F.lit(False)).alias(_READ))
    return _once(second, _doc=document).select(*df.columns, "_doc"), Document("_doc", texts, numbers, payload)
