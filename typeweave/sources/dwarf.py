"""A Spark data source for the debug information of ELF files.

`spark.read.format("debuginfo").load(path)` gives a row for each entry (the
`die` table), a partition for each unit.  It reads little-endian ELF files of 32
or 64 bits with units of versions 2 to 5, in either format, in .debug_info.
References to other units keep their id, as do signatures of type units there;
other signatures, and references to supplementary files, are errors.  Units in
.debug_types of version 4 and split units are left out.
"""

from __future__ import annotations

import itertools
import mmap
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "cu_offset long, goff long, parent long, ord int, depth int, tag string, name string, linkage_name string, type_ref long, spec_ref long, origin_ref long, "
    "containing_ref long, byte_size long, bit_size long, const_value long, count long, member_loc long, encoding string, declaration boolean, external boolean, "
    "inline_code string, virtuality string, vtable_idx long, low_pc long"
)

# Tags and attributes of the format that are read, and values of some attributes.
TAGS = {
    0x01: "array_type", 0x02: "class_type", 0x04: "enumeration_type", 0x05: "formal_parameter", 0x08: "imported_declaration", 0x0B: "lexical_block", 0x0D: "member",
    0x0F: "pointer_type", 0x10: "reference_type", 0x11: "compile_unit", 0x13: "structure_type", 0x15: "subroutine_type", 0x16: "typedef", 0x17: "union_type",
    0x18: "unspecified_parameters", 0x1C: "inheritance", 0x1D: "inlined_subroutine", 0x1F: "ptr_to_member_type", 0x21: "subrange_type", 0x24: "base_type",
    0x26: "const_type", 0x28: "enumerator", 0x2E: "subprogram", 0x2F: "template_type_parameter", 0x30: "template_value_parameter", 0x34: "variable",
    0x35: "volatile_type", 0x37: "restrict_type", 0x39: "namespace", 0x3A: "imported_module", 0x3B: "unspecified_type", 0x42: "rvalue_reference_type",
    0x0A: "label", 0x25: "catch_block", 0x32: "try_block", 0x3C: "partial_unit", 0x3D: "imported_unit", 0x41: "type_unit", 0x43: "template_alias", 0x47: "atomic_type", 0x49: "call_site_parameter",
    0x48: "call_site", 0x4109: "GNU_call_site", 0x410A: "GNU_call_site_parameter", 0x4107: "GNU_template_parameter_pack",
}
ATTRIBUTES = {
    0x03: "name", 0x0B: "byte_size", 0x0D: "bit_size", 0x11: "low_pc", 0x1C: "const_value", 0x1D: "containing_ref", 0x20: "inline_code", 0x2F: "upper_bound",
    0x31: "origin_ref", 0x37: "count", 0x38: "member_loc", 0x3C: "declaration", 0x3E: "encoding", 0x3F: "external", 0x47: "spec_ref", 0x49: "type_ref",
    0x4C: "virtuality", 0x4D: "vtable_idx", 0x6B: "bit_offset", 0x6E: "linkage_name", 0x2007: "linkage_name",
}
ENCODINGS = {1: "address", 2: "boolean", 4: "float", 5: "signed", 6: "signed_char", 7: "unsigned", 8: "unsigned_char", 16: "UTF"}
INLINE = {0: "not_inlined", 1: "inlined", 2: "declared_not_inlined", 3: "declared_inlined"}
VIRTUALITY = {0: "none", 1: "virtual", 2: "pure_virtual"}
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class FormatError(ValueError):
    """The file is not what this reader reads."""


def sections(data: bytes) -> dict[str, tuple[int, int]]:
    """(offset, size) of each section by name; a section that isn't there is empty for readers."""
    if data[:4] != b"\x7fELF" or data[4] not in (1, 2) or data[5] != 1:
        raise FormatError("not a little-endian ELF file")
    wide = data[4] == 2
    table = struct.unpack_from("<Q" if wide else "<I", data, 0x28 if wide else 0x20)[0]
    size, number, names = struct.unpack_from("<HHH", data, 0x3A if wide else 0x2E)
    headers = [struct.unpack_from("<IIQQQQ" if wide else "<IIIIII", data, table + i * size) for i in range(number)]
    strings = headers[names][4]
    out = {}
    for h in headers:
        end = data.find(b"\0", strings + h[0])
        out[bytes(data[strings + h[0] : end]).decode()] = (h[4], h[5])
    return out


class Section:
    """A cursor over part of a file."""

    def __init__(self, data: bytes, at: int, end: int) -> None:
        self.data, self.at, self.end = data, at, end

    def fixed(self, n: int, signed: bool = False) -> int:
        value = int.from_bytes(self.data[self.at : self.at + n], "little", signed=signed)
        self.at += n
        return value

    def uleb(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    def sleb(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out - (1 << shift) if b & 64 else out

    def string(self) -> str:
        end = self.data.find(b"\0", self.at)
        out = bytes(self.data[self.at : end]).decode("utf-8", "replace")
        self.at = end + 1
        return out


@dataclass
class Unit:
    """Where a unit is in .debug_info, and what its header says; `first` is the place of its first entry."""

    offset: int
    length: int
    version: int
    wide: bool
    address: int
    abbreviations: int
    first: int
    signature: int | None = None
    type_at: int = 0
    strings_base: int = 0
    addresses_base: int = 0

    @property
    def width(self) -> int:
        return 8 if self.wide else 4


def units(data: bytes) -> list[Unit]:
    """The units of .debug_info."""
    start, size = sections(data).get(".debug_info", (0, 0))
    out, at = [], 0
    while at < size:
        c = Section(data, start + at, start + size)
        length = c.fixed(4)
        wide = length == 0xFFFFFFFF
        if wide:
            length = c.fixed(8)
        whole = c.at - start - at + length
        version, signature, type_at = c.fixed(2), None, 0
        if not 2 <= version <= 5:
            raise FormatError(f"version {version} units are not read")
        kind = c.fixed(1) if version == 5 else 1
        if version == 5:
            address, table = c.fixed(1), c.fixed(8 if wide else 4)
        else:
            table, address = c.fixed(8 if wide else 4), c.fixed(1)
        if kind in (2, 6):  # type units
            signature, type_at = c.fixed(8), c.fixed(8 if wide else 4)
        elif kind in (4, 5):  # skeletons and split units
            c.fixed(8)
        out.append(Unit(at, whole, version, wide, address, table, c.at - start, signature, type_at))
        at += whole
    return out


def abbreviations(data: bytes, at: int) -> dict[int, tuple[int, bool, list[tuple[int, int, int]]]]:
    """Code -> (tag, whether it has children, (attribute, form, the value that the form itself carries))."""
    cursor, out = Section(data, at, len(data)), {}
    while code := cursor.uleb():
        tag, children, found = cursor.uleb(), bool(cursor.fixed(1)), []
        while True:
            attribute, form = cursor.uleb(), cursor.uleb()
            if not attribute and not form:
                break
            found.append((attribute, form, cursor.sleb() if form == 0x21 else 0))
        out[code] = (tag, children, found)
    return out


# Bytes that a form takes, for forms of constants, references, indices into tables and blocks.
CONSTANTS = {0x0B: 1, 0x05: 2, 0x06: 4, 0x07: 8, 0x1E: 16}
REFERENCES = {0x11: 1, 0x12: 2, 0x13: 4, 0x14: 8}
STRING_INDICES, ADDRESS_INDICES = {0x25: 1, 0x26: 2, 0x27: 3, 0x28: 4}, {0x29: 1, 0x2A: 2, 0x2B: 3, 0x2C: 4}
BLOCKS = {0x0A: 1, 0x03: 2, 0x04: 4}


class Values:
    """The values of a unit's attributes."""

    def __init__(self, data: bytes, unit: Unit) -> None:
        self.data, self.unit, self.where = data, unit, sections(data)
        self.signatures: dict[int, int] | None = None

    def _string(self, section: str, at: int) -> str:
        at += self.where.get(section, (0, 0))[0]
        return bytes(self.data[at : self.data.find(b"\0", at)]).decode("utf-8", "replace")

    def _string_at(self, index: int) -> str:
        at = self.where.get(".debug_str_offsets", (0, 0))[0] + self.unit.strings_base + index * self.unit.width
        return self._string(".debug_str", Section(self.data, at, at).fixed(self.unit.width))

    def _address_at(self, index: int) -> int:
        at = self.where.get(".debug_addr", (0, 0))[0] + self.unit.addresses_base + index * self.unit.address
        return Section(self.data, at, at).fixed(self.unit.address)

    def _type_of(self, signature: int) -> int:
        if self.signatures is None:
            self.signatures = {u.signature: u.offset + u.type_at for u in units(self.data) if u.signature is not None}
        if signature not in self.signatures:
            raise FormatError(f"no type unit has the signature {signature:#x}")
        return self.signatures[signature]

    def _block(self, c: Section, form: int) -> int | None:
        """The constant of a block that is one unsigned constant or offset, else nothing."""
        n = c.fixed(BLOCKS[form]) if form in BLOCKS else c.uleb()
        body = Section(self.data, c.at, c.at + n)
        c.at += n
        if n and self.data[body.at] in (0x10, 0x23):
            body.at += 1
            value = body.uleb()
            return value if body.at == body.end else None
        return None

    def read(self, c: Section, form: int, carried: int) -> object:
        """A value; references become ids, offsets into other sections a tuple, which is no value of a column."""
        width = self.unit.width
        if form == 0x21:
            return carried
        if form in CONSTANTS:
            return c.fixed(CONSTANTS[form])
        if form in (0x0D, 0x0F):
            return c.sleb() if form == 0x0D else c.uleb()
        if form == 0x01:
            return c.fixed(self.unit.address)
        if form == 0x08:
            return c.string()
        if form in (0x0E, 0x1F):
            return self._string(".debug_str" if form == 0x0E else ".debug_line_str", c.fixed(width))
        if form == 0x1A or form in STRING_INDICES:
            return self._string_at(c.fixed(STRING_INDICES[form]) if form in STRING_INDICES else c.uleb())
        if form == 0x1B or form in ADDRESS_INDICES:
            return self._address_at(c.fixed(ADDRESS_INDICES[form]) if form in ADDRESS_INDICES else c.uleb())
        if form in (0x0C, 0x19):
            return bool(c.fixed(1)) if form == 0x0C else True
        if form in REFERENCES or form == 0x15:
            return self.unit.offset + (c.fixed(REFERENCES[form]) if form in REFERENCES else c.uleb())
        if form == 0x10:
            return c.fixed(self.unit.address if self.unit.version == 2 else width)
        if form == 0x20:
            return self._type_of(c.fixed(8))
        if form == 0x17:
            return ("section", c.fixed(width))
        if form in (0x22, 0x23):
            return ("list", c.uleb())
        if form in (0x18, 0x09) or form in BLOCKS:
            return self._block(c, form)
        if form == 0x16:
            return self.read(c, c.uleb(), 0)
        raise FormatError(f"form {form:#x} is not read")


def _i64(x: object) -> int | None:
    """An integer as a signed one of 64 bits; wider ones, and what is none, are null."""
    return None if not isinstance(x, int) or isinstance(x, bool) or x >= 1 << 64 else x - (1 << 64) if x >= 1 << 63 else x


def entries(data: bytes, unit: Unit) -> Iterator[dict[str, object]]:
    """The rows of a unit, in order of the file."""
    start = sections(data)[".debug_info"][0]
    c = Section(data, start + unit.first, start + unit.offset + unit.length)
    table = abbreviations(data, sections(data)[".debug_abbrev"][0] + unit.abbreviations)
    values = Values(data, unit)
    _bases(data, unit, table, values, c.at, c.end)
    stack: list[list[int]] = []
    while c.at < c.end:
        goff = c.at - start
        code = c.uleb()
        if not code:
            if stack:
                stack.pop()
            continue
        tag, children, wanted = table[code]
        row: dict[str, object] = {}
        for attribute, form, carried in wanted:
            value = values.read(c, form, carried)
            column = ATTRIBUTES.get(attribute)
            if column and not isinstance(value, tuple):
                row[column] = value
        if "count" not in row and isinstance(row.get("upper_bound"), int):
            row["count"] = int(row["upper_bound"]) + 1
        if "member_loc" not in row and isinstance(row.get("bit_offset"), int):
            row["member_loc"] = int(row["bit_offset"]) // 8
        place = 0
        if stack:
            place = stack[-1][1]
            stack[-1][1] += 1
        row |= {"cu_offset": unit.offset, "goff": goff, "parent": stack[-1][0] if stack else None, "ord": place, "depth": len(stack), "tag": TAGS.get(tag, f"tag_{tag:#x}")}
        for column, names in (("encoding", ENCODINGS), ("inline_code", INLINE), ("virtuality", VIRTUALITY)):
            if column in row:
                row[column] = names.get(row[column], str(row[column]))
        yield row
        if children:
            stack.append([goff, 0])


def _bases(data: bytes, unit: Unit, table: dict, values: Values, at: int, end: int) -> None:
    """Where the unit's parts of the tables of strings and addresses begin: its first entry says so, if need be behind values that use them."""
    c = Section(data, at, end)
    code = c.uleb() if at < end else 0
    for attribute, form, carried in table[code][2] if code else ():
        plain = form != 0x1A and form != 0x1B and form not in STRING_INDICES and form not in ADDRESS_INDICES
        if plain:
            value = values.read(c, form, carried)
        elif form in (0x1A, 0x1B):
            value = c.uleb()
        else:
            value = c.fixed((STRING_INDICES | ADDRESS_INDICES)[form])
        if attribute == 0x72 and isinstance(value, tuple):
            unit.strings_base = value[1]
        elif attribute == 0x73 and isinstance(value, tuple):
            unit.addresses_base = value[1]


def _batch(rows: list[dict[str, object]]) -> pa.RecordBatch:
    columns = []
    for field in SCHEMA.split(", "):
        name, kind = field.split()
        got = [r.get(name) for r in rows]
        if kind == "boolean":
            columns.append(pa.array([None if x is None else bool(x) for x in got], pa.bool_()))
        elif kind == "string":
            columns.append(pa.array([x if isinstance(x, str) else None for x in got], pa.string()))
        else:
            columns.append(pa.array([_i64(x) for x in got], pa.int32() if kind == "int" else pa.int64()))
    return pa.RecordBatch.from_arrays(columns, COLUMNS)


class _Part(InputPartition):
    def __init__(self, path: str, unit: Unit | None) -> None:
        self.path, self.unit = path, unit


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return [_Part(self.path, u) for u in units(data)] or [_Part(self.path, None)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.unit is None:
            return
        with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            rows = entries(data, partition.unit)
            while some := list(itertools.islice(rows, 10_000)):
                yield _batch(some)


class DebugInfo(DataSource):
    """`debuginfo`: the entries of one file, which all executors can open at `path`."""

    @classmethod
    def name(cls) -> str:
        return "debuginfo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
