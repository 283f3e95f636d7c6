"""HL7 v2 parsing as column expressions.

A parsed message is ``message`` (the first line) plus ``segments``, an array of
``struct<id, fields>``.  Nothing here explodes: repeating segments stay arrays
and are transformed in place, so a report is assembled without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component order of the HL7 name types.
NAME_PARTS = (
    "family_name",
    "given_name",
    "second_and_further_names",
    "suffix",
    "prefix",
    "degree",
    "name_type_code",
)
NAME_WITH_ID_PARTS = ("id_number",) + NAME_PARTS + (
    "assigning_authority",
    "identifier_type_code",
    "assigning_facility",
)

# OBX-3 suffixes that mark a report section.
SECTION_SUFFIXES = {
    "addendum": ("ADT", "ADN"),
    "findings": ("GDT",),
    "impression": ("IMP",),
    "technician_note": ("TCM",),
}

# Component position (1-based) of each part in the wire formats.
XPN_POSITIONS = {part: i + 1 for i, part in enumerate(NAME_PARTS)}
XCN_POSITIONS = {
    "id_number": 1,
    "family_name": 2,
    "given_name": 3,
    "second_and_further_names": 4,
    "suffix": 5,
    "prefix": 6,
    "degree": 7,
    "assigning_authority": 9,
    "name_type_code": 10,
    "identifier_type_code": 13,
    "assigning_facility": 14,
}
# The interpreter and technician fields carry no type, id-type or facility part.
CNN_POSITIONS = {
    part: position
    for part, position in XCN_POSITIONS.items()
    if part not in ("name_type_code", "identifier_type_code", "assigning_facility")
}
PATIENT_ID_POSITIONS = {
    "id_number": 1,
    "assigning_authority": 4,
    "identifier_type_code": 5,
    "assigning_facility": 6,
}

Mapper = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message_line(content: Column | str) -> Column:
    """First line of a message, verbatim (it may be blank)."""
    return F.regexp_extract(_col(content), r"^[^\r\n]*", 0)


def parse_segments(content: Column | str) -> Column:
    """All later non-empty lines as ``array<struct<id, fields>>``.

    Any of CR, LF and CRLF ends a line.  Trailing empty fields are dropped,
    interior ones kept; a line of pipes only becomes a segment with empty id.
    """
    content = _col(content)
    body = F.substr(content, F.length(message_line(content)) + F.lit(1))
    lines = F.regexp_extract_all(body, F.lit(r"([^\r\n]+)"), F.lit(1))
    tokens = F.transform(lines, lambda line: F.split(F.rtrim(line, F.lit("|")), r"\|"))
    return F.transform(
        tokens,
        lambda t: F.struct(
            F.get(t, F.lit(0)).alias("id"),
            F.slice(t, F.lit(2), F.size(t)).alias("fields"),
        ),
    )


def segments(name: str, source: Column | str = "segments") -> Column:
    """Every segment with this id, in message order."""
    return F.filter(_col(source), lambda s: s["id"] == F.lit(name))


def segment(name: str, source: Column | str = "segments") -> Column:
    """Fields of the first segment with this id, NULL when there is none."""
    return F.get(segments(name, source), F.lit(0))["fields"]


def header(source: Column | str = "message") -> Column:
    """Header fields such that ``field(header(), n)`` is MSH-n.

    The field separator itself counts as MSH-1, which makes up for the segment
    id at the front of the split line.
    """
    return F.split(_col(source), r"\|")


def field(seg: Column, n: int) -> Column:
    """HL7 field ``n`` (1-based) of a segment; NULL when absent."""
    return F.get(seg, F.lit(n - 1))


def component(seg: Column, n: int, k: int = 1) -> Column:
    """Component ``k`` of field ``n`` (both 1-based); NULL when absent."""
    value = field(seg, n)
    if k == 1:
        return F.substring_index(value, "^", 1)
    return F.get(F.split(value, r"\^"), F.lit(k - 1))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def struct_of(parts: Column, names: Sequence[str], positions: dict[str, int]) -> Column:
    """Struct of the named components; blank and unmapped parts are NULL."""
    return F.struct(
        *[
            (
                blank_to_null(F.get(parts, F.lit(positions[name] - 1)))
                if name in positions
                else F.lit(None).cast("string")
            ).alias(name)
            for name in names
        ]
    )


def repeated(c: Column | str, mapper: Mapper, keep: Mapper | None = None) -> Column:
    """Map each ``~`` repetition, given as its ``^`` components, to a value."""
    # Split in a pass of its own: inside the mapper every part would split again.
    parts = F.transform(F.split(_col(c), "~"), lambda repetition: F.split(repetition, r"\^"))
    mapped = F.transform(parts, mapper)
    return F.filter(mapped, keep) if keep is not None else mapped


def xpn(c: Column | str, keep: Mapper | None = None) -> Column:
    """Person names."""
    return repeated(c, lambda p: struct_of(p, NAME_PARTS, XPN_POSITIONS), keep)


def xcn(c: Column | str, keep: Mapper | None = None) -> Column:
    """Person names with identifiers."""
    return repeated(c, lambda p: struct_of(p, NAME_WITH_ID_PARTS, XCN_POSITIONS), keep)


def cnn(c: Column | str, keep: Mapper | None = None) -> Column:
    """Person names with identifiers in the interpreter and technician fields."""
    return repeated(c, lambda p: struct_of(p, NAME_WITH_ID_PARTS, CNN_POSITIONS), keep)


def has_family_name(name: Column) -> Column:
    return name["family_name"].isNotNull()


def _given_family(name: Column) -> Column:
    return F.concat_ws(" ", name["given_name"], name["family_name"])


def friendly_first(names: Column | str) -> Column:
    """"GIVEN FAMILY" of the first name; empty string when there is none."""
    return _given_family(F.get(_col(names), F.lit(0)))


def friendly_all(names: Column | str) -> Column:
    """Distinct "GIVEN FAMILY" strings."""
    return F.array_distinct(F.transform(_col(names), _given_family))


def patient_ids(c: Column | str) -> Column:
    """Patient identifiers of PID-3, without social security numbers."""
    names = tuple(PATIENT_ID_POSITIONS)
    return repeated(
        c,
        lambda p: struct_of(p, names, PATIENT_ID_POSITIONS),
        lambda i: ~i["identifier_type_code"].eqNullSafe(F.lit("SS")),
    )


def patient_id_key(i: Column) -> Column:
    """Column name an identifier belongs to; NULL when it names no issuer."""
    both = i["assigning_authority"].isNotNull() & i["identifier_type_code"].isNotNull()
    return (
        F.when(i["id_number"].isNull(), F.lit(None).cast("string"))
        .when(
            both,
            F.concat_ws(
                "_", F.lower(i["assigning_authority"]), F.lower(i["identifier_type_code"])
            ),
        )
        .when(
            i["assigning_facility"].isNotNull(),
            F.concat(F.lit("legacy_patient_id_"), F.lower(i["assigning_facility"])),
        )
    )


def keyed_patient_ids(ids: Column | str) -> Column:
    """``key, id_number`` of each identifier."""
    return F.transform(_col(ids), lambda i: F.struct(patient_id_key(i).alias("key"), i["id_number"].alias("id_number")))


def keyed_id_value(keyed: Column | str, key: str) -> Column:
    """Smallest of the keyed identifiers under ``key``; NULL when there is none."""
    matching = F.filter(_col(keyed), lambda i: i["key"] == F.lit(key))
    return F.array_min(F.transform(matching, lambda i: i["id_number"]))


def patient_id_value(ids: Column | str, key: str) -> Column:
    """Smallest identifier filed under ``key``; NULL when there is none."""
    return keyed_id_value(keyed_patient_ids(ids), key)


def parse_hl7_date(c: Column | str) -> Column:
    """Date of the first eight characters; NULL when invalid.

    Digits are tested first: a failing parse costs an exception per row.
    """
    day = F.substring(_col(c), 1, 8)
    return F.when(day.rlike(r"^\d{8}$"), F.try_to_date(day, "yyyyMMdd"))


def parse_hl7_ts(c: Column | str) -> Column:
    """Timestamp of ``yyyyMMddHHmm[ss]``; NULL when invalid."""
    c = _col(c)
    padded = F.when(F.length(c) == 12, F.concat(c, F.lit("00"))).otherwise(c)
    return F.when(
        c.rlike(r"^\d{12}(\d\d)?$"), F.try_to_timestamp(padded, F.lit("yyyyMMddHHmmss"))
    )


def observation_text(fields: Column) -> Column:
    """Text of one OBX line; ``~`` separates lines in the TX type only."""
    value = field(fields, 5)
    return F.when(field(fields, 2) == "TX", F.replace(value, F.lit("~"), F.lit("\n"))).otherwise(
        value
    )


def assemble_text(obx: Column) -> Column:
    """Report text in message order; NULL when the message has no OBX line."""
    return text_of_lines(obx, observation_lines(obx))


def observation_lines(obx: Column) -> Column:
    """``text, suffix`` of each OBX line, the suffix being what follows ``&`` in OBX-3."""
    return F.transform(
        obx,
        lambda s: F.struct(
            observation_text(s["fields"]).alias("text"),
            F.get(F.split(field(s["fields"], 3), "&"), F.lit(1)).alias("suffix"),
        ),
    )


def text_of_lines(obx: Column, lines: Column, suffixes: Sequence[str] | None = None) -> Column:
    """Text of all lines, or of those with a listed suffix; NULL when the message has no OBX line."""
    chosen = lines if suffixes is None else F.filter(lines, lambda s: s["suffix"].isin(*suffixes))
    return F.when(F.size(obx) > 0, F.concat_ws("\n", F.transform(chosen, lambda s: s["text"])))


def report_status(obx: Column) -> Column:
    """OBX-11 of the first line."""
    return field(F.get(obx, F.lit(0))["fields"], 11)


def section(obx: Column, suffixes: Sequence[str]) -> Column:
    """Lines whose OBX-3 ``&`` suffix is listed.

    Empty string, not NULL, when the message has lines but none of them match.
    """
    return text_of_lines(obx, observation_lines(obx), suffixes)


def diagnoses(dg1: Column) -> Column:
    """DG1-3 of each diagnosis segment as code, text and coding system."""

    def one(parts: Column) -> Column:
        return F.struct(
            F.get(parts, F.lit(0)).alias("diagnosis_code"),
            F.get(parts, F.lit(1)).alias("diagnosis_code_text"),
            F.get(parts, F.lit(2)).alias("diagnosis_code_coding_system"),
        )

    return F.transform(F.transform(dg1, lambda s: F.split(field(s["fields"], 3), r"\^")), one)


def diagnoses_consolidated(dx: Column | str) -> Column:
    return F.array_join(F.transform(_col(dx), lambda d: d["diagnosis_code_text"]), "; ")
