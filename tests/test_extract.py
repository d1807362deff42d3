import re
import shutil
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from typeweave.operators import load, namespace, symbols
from typeweave.plans.extract import extract
from typeweave.sources import config, dwarf
from typeweave.sources.caches import cached

needs_readelf = pytest.mark.skipif(not shutil.which("readelf"), reason="needs readelf")

TAG = {v: k for k, v in dwarf.TAGS.items()}
ATTRIBUTE = {"name": 0x03, "byte_size": 0x0B, "bit_size": 0x0D, "low_pc": 0x11, "const_value": 0x1C, "containing_ref": 0x1D, "inline_code": 0x20, "upper_bound": 0x2F, "origin_ref": 0x31, "member_loc": 0x38, "declaration": 0x3C, "encoding": 0x3E, "external": 0x3F, "spec_ref": 0x47, "type_ref": 0x49, "virtuality": 0x4C, "vtable_idx": 0x4D, "linkage_name": 0x6E, "str_offsets_base": 0x72}


def uleb(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        if not n:
            return out + bytes([low])
        out += bytes([low | 128])


def sleb(n):
    out = b""
    while True:
        low = n & 127
        n >>= 7
        if n == (-1 if low & 64 else 0):
            return out + bytes([low])
        out += bytes([low | 128])


class E:
    """An entry of debug information; attributes that are entries become references."""

    def __init__(self, tag, *children, **attributes):
        self.tag, self.children, self.attributes, self.at = tag, children, attributes, None


def build(units, version=4, wide=False):
    """An ELF file with the units' entries; those of version 5 use forms that are new with it."""
    abbrev, codes, strings, info, line_strings, indices = b"", {}, b"\0", b"", b"\0", []
    offset = "<Q" if wide else "<I"

    def form(name, v, base):
        if isinstance(v, E):
            return 0x10 if v.at is not None and v.at < base else 0x13
        if name == "str_offsets_base":
            return 0x17
        if isinstance(v, str):
            if version == 5 and len(v) > 4:
                return 0x25 if name == "linkage_name" else 0x1F
            return 0x0E if len(v) > 4 else 0x08
        if version == 5 and name == "byte_size":
            return 0x21
        if v is True:
            return 0x19
        if name == "vtable_idx":
            return 0x18
        return {"const_value": 0x0D, "low_pc": 0x01, "member_loc": 0x0F}.get(name, 0x0B)

    def write(e, base, out):
        nonlocal abbrev, strings, line_strings
        shape = (e.tag, bool(e.children), tuple((n, form(n, v, base), v if form(n, v, base) == 0x21 else None) for n, v in e.attributes.items()))
        if shape not in codes:
            codes[shape] = len(codes) + 1
            abbrev += uleb(codes[shape]) + uleb(TAG[e.tag]) + bytes([shape[1]]) + b"".join(uleb(ATTRIBUTE[n]) + uleb(f) + (sleb(v) if f == 0x21 else b"") for n, f, v in shape[2]) + b"\0\0"
        e.at = base + len(out)
        out += uleb(codes[shape])
        for n, v in e.attributes.items():
            f = form(n, v, base)
            if f == 0x13:
                out += struct.pack("<I", (v.at or base) - base)
            elif f == 0x10:
                out += struct.pack("<Q" if version == 2 else offset, v.at)
            elif f == 0x17:
                out += struct.pack(offset, v)
            elif f == 0x0E:
                out += struct.pack(offset, len(strings))
                strings += v.encode() + b"\0"
            elif f == 0x1F:
                out += struct.pack(offset, len(line_strings))
                line_strings += v.encode() + b"\0"
            elif f == 0x25:
                out += bytes([len(indices)])
                indices.append(len(strings))
                strings += v.encode() + b"\0"
            elif f == 0x08:
                out += v.encode() + b"\0"
            elif f == 0x18:
                out += bytes([2, 0x10, v])
            elif f == 0x01:
                out += struct.pack("<Q", v)
            elif f not in (0x19, 0x21):
                out += sleb(v) if f == 0x0D else uleb(v) if f == 0x0F else bytes([v])
        for c in e.children:
            write(c, base, out)
        if e.children:
            out += b"\0"

    for unit in units:
        if version == 5:
            unit.attributes["str_offsets_base"] = 16 if wide else 8
        for _ in range(2):  # the second time every reference is known
            saved = strings, line_strings, len(indices)
            body = bytearray((12 if wide else 4) + (2 + 2 if version == 5 else 2 + 1) + (8 if wide else 4))
            head = len(body)
            write(unit, len(info), body)
            if not _:
                strings, line_strings = saved[:2]
                del indices[saved[2] :]
        length = struct.pack("<IQ", 0xFFFFFFFF, len(body) - 12) if wide else struct.pack("<I", len(body) - 4)
        body[:head] = length + (struct.pack("<HBB", 5, 1, 8) + struct.pack(offset, 0) if version == 5 else struct.pack("<H", version) + struct.pack(offset, 0) + b"\x08")
        info += bytes(body)
    parts = {".debug_info": info, ".debug_abbrev": abbrev + b"\0", ".debug_str": strings}
    if version == 5:
        table = struct.pack("<HH", 5, 0) + b"".join(struct.pack(offset, i) for i in indices)
        parts[".debug_str_offsets"] = (struct.pack("<IQ", 0xFFFFFFFF, len(table)) if wide else struct.pack("<I", len(table))) + table
        parts[".debug_line_str"] = line_strings
    names, table, data, at = b"\0", [(0,) * 10], b"", 64
    for name, content in [*parts.items(), (".shstrtab", None)]:
        place = len(names)
        names += name.encode() + b"\0"
        content = names if content is None else content
        table.append((place, 3 if name == ".shstrtab" else 1, 0, 0, at, len(content), 0, 0, 1, 0))
        data += content
        at += len(content)
    header = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 1, 62, 1, 0, 0, at, 0, 64, 0, 0, 64, len(table), len(table) - 1)
    return header + data + b"".join(struct.pack("<IIQQQQIIQQ", *row) for row in table)


def node_types():
    """The types that both units have: a list node, an enumeration, and what they need."""
    integer, real, letter = E("base_type", name="int", byte_size=4, encoding=5), E("base_type", name="float", byte_size=4, encoding=4), E("base_type", name="char", byte_size=1, encoding=6)
    unsigned = E("base_type", name="unsigned int", byte_size=4, encoding=7)
    uid = E("typedef", name="uid", type_ref=unsigned)
    color = E("enumeration_type", E("enumerator", name="RED", const_value=0), E("enumerator", name="GREEN", const_value=-7), name="Color", byte_size=4)
    node = E("structure_type", name="Node", byte_size=48)
    point = E("pointer_type", type_ref=node, byte_size=8)
    grid = E("array_type", E("subrange_type", upper_bound=1), E("subrange_type", upper_bound=2), type_ref=integer)
    node.children = (
        E("member", name="next", type_ref=point, member_loc=0), E("member", name="id", type_ref=uid, member_loc=8), E("member", name="color", type_ref=color, member_loc=12),
        E("member", name="bits", type_ref=integer, member_loc=16, bit_size=3), E("member", name="more", type_ref=integer, member_loc=16, bit_size=4),
        E("member", name="count", type_ref=integer, external=True, declaration=True), E("member", name="grid", type_ref=grid, member_loc=20),
    )
    return integer, real, letter, uid, unsigned, color, node, point, grid


@pytest.fixture(scope="module")
def program(tmp_path_factory):
    integer, real, letter, uid, unsigned, color, node, point, grid = node_types()
    either = E("union_type", E("member", name="a", type_ref=integer), E("member", name="b", type_ref=real), name="Either", byte_size=4)
    base = E("structure_type", name="Base", byte_size=8)
    base_point = E("pointer_type", type_ref=base)
    entry = E("pointer_type", byte_size=8)
    run = E("subprogram", E("formal_parameter", type_ref=base_point), E("formal_parameter", type_ref=integer), name="run", linkage_name="_ZN3app4Base3runEi", type_ref=integer, external=True, declaration=True, virtuality=1, vtable_idx=2)
    base.children = (E("member", name="_vptr.Base", type_ref=entry, member_loc=0), E("subprogram", E("formal_parameter", type_ref=base_point), name="~Base", external=True, declaration=True, virtuality=1, vtable_idx=0), run)
    signature = E("subroutine_type", E("formal_parameter", type_ref=point), E("formal_parameter", type_ref=letter), type_ref=integer)
    call = E("pointer_type", type_ref=signature)
    to_member = E("ptr_to_member_type", type_ref=integer, containing_ref=node)
    derived = E("structure_type", E("inheritance", type_ref=base, member_loc=0), E("member", name="e", type_ref=either, member_loc=8), E("member", name="call", type_ref=call, member_loc=16), E("member", name="member", type_ref=to_member, member_loc=24), name="Derived", byte_size=32)
    items = E("array_type", E("subrange_type", upper_bound=3), type_ref=uid)
    box = E("structure_type", E("template_type_parameter", name="T", type_ref=uid), E("template_value_parameter", name="N", type_ref=integer, const_value=4), E("member", name="items", type_ref=items, member_loc=0), name="Box<unsigned int, 4>", byte_size=16)
    derived_point = E("pointer_type", type_ref=derived)
    declared = E("variable", name="box", type_ref=box, external=True, declaration=True, linkage_name="box")
    one = E(
        "compile_unit", integer, real, letter, unsigned, E("namespace", uid, color, node, either, base, derived, box, name="app"), point, grid, base_point, entry, signature, call, to_member, items, derived_point,
        E("variable", name="first", type_ref=node, external=True, linkage_name="first"), declared, E("variable", spec_ref=declared),
        E("subprogram", E("formal_parameter", name="node", type_ref=point), E("formal_parameter", type_ref=integer), name="walk", linkage_name="_Z4walkPN3app4NodeEi", type_ref=integer, external=True, low_pc=4096),
        E("subprogram", name="make", linkage_name="_Z4makev", type_ref=derived_point, external=True, low_pc=4112), name="one.cpp",
    )
    integer, real, letter, uid, unsigned, color, node, point, grid = node_types()
    hidden = E("structure_type", name="Hidden", declaration=True)
    hidden_point, ref = E("pointer_type", type_ref=hidden), E("reference_type", type_ref=node)
    two = E(
        "compile_unit", integer, real, letter, unsigned, E("namespace", uid, color, node, hidden, name="app"), point, grid, hidden_point, ref,
        E("variable", name="hidden", type_ref=hidden_point, external=True, linkage_name="hidden"), E("variable", name="second", type_ref=node, external=True, linkage_name="second"),
        E("subprogram", E("formal_parameter", name="n", type_ref=ref), name="other", linkage_name="_Z5otherRN3app4NodeE", type_ref=integer, external=True, low_pc=4160), name="two.cpp",
    )
    out = tmp_path_factory.mktemp("elf") / "lib.o"
    out.write_bytes(build([one, two]))
    return out


@pytest.fixture(scope="module")
def die(spark, program):
    spark.dataSource.register(dwarf.DebugInfo)
    return spark.read.format("debuginfo").load(str(program)).cache()


@needs_readelf
def test_reader_equals_readelf(die, program):
    text = subprocess.run(["readelf", "--debug-dump=info", str(program)], capture_output=True, text=True).stdout
    want = {int(m[1], 16): m[2] for m in re.finditer(r"<\w+><(\w+)>: Abbrev Number: \d+ \(DW_TAG_(\w+)\)", text)}
    got = {r["goff"]: r["tag"] for r in die.select("goff", "tag").collect()}
    assert got == {k: re.sub("_param$", "_parameter", v) for k, v in want.items()}  # readelf abbreviates
    names = sorted(re.findall(r"DW_AT_name\s+: (?:\(indirect string, offset: \w+\): )?(\S.*?)\s*$", text, re.M))
    assert sorted(r["name"] for r in die.where("name is not null").select("name").collect()) == names
    refs = sorted(int(x, 16) for x in re.findall(r"DW_AT_type\s+: <0x(\w+)>", text))
    assert sorted(r["type_ref"] for r in die.where("type_ref is not null").select("type_ref").collect()) == refs


def some_units():
    integer, real, letter, uid, unsigned, color, node, point, grid = node_types()
    one = E("compile_unit", integer, real, letter, unsigned, E("namespace", uid, color, node, name="app"), point, grid, E("variable", name="first", type_ref=node, linkage_name="_ZN3app5firstE"), name="one.cpp")
    return [one, E("compile_unit", E("variable", name="second", type_ref=node, linkage_name="_ZN3app6secondE"), name="two.cpp")], node


@needs_readelf
@pytest.mark.parametrize(("version", "wide"), [(2, False), (3, False), (3, True), (4, True), (5, False), (5, True)])
def test_reader_of_other_versions(spark, tmp_path, version, wide):
    """Units of each version and format, with references between units, equal those of version 4 but for the places of entries."""
    found = {}
    for v, w in {(4, False), (version, wide)}:
        units, node = some_units()
        out = tmp_path / f"{v}{w}.o"
        out.write_bytes(build(units, v, w))
        spark.dataSource.register(dwarf.DebugInfo)
        rows = spark.read.format("debuginfo").load(str(out)).orderBy("goff").collect()
        assert next(r for r in rows if r["name"] == "second")["type_ref"] == node.at, "a reference to another unit keeps its id"
        number = {r["goff"]: i for i, r in enumerate(rows)}
        found[v, w] = [{k: number[x] if k in ("goff", "parent", "type_ref") and x is not None else x for k, x in r.asDict().items() if k != "cu_offset"} for r in rows]
        text = subprocess.run(["readelf", "--debug-dump=info", str(out)], capture_output=True, text=True).stdout
        want = [int(m[1], 16) for m in re.finditer(r"<\w+><(\w+)>: Abbrev Number: \d+ \(DW_TAG_", text)]
        assert sorted(number) == want
    assert found[4, False] == found[version, wide]


def test_unread_files_are_errors():
    units, _ = some_units()
    data = build(units)
    with pytest.raises(dwarf.FormatError, match="version 9"):
        dwarf.units(data[:64 + 4] + b"\x09\x00" + data[70:])
    with pytest.raises(dwarf.FormatError, match="ELF"):
        dwarf.sections(b"MZ" + data)
    with pytest.raises(dwarf.FormatError, match="signature"):
        dwarf.Values(data, dwarf.units(data)[0]).read(dwarf.Section(bytes(8), 0, 8), 0x20, 0)


def test_paths(die):
    got = namespace.paths(die).join(die.select("goff", "name", "tag", "declaration"), "goff").where("name = 'Node' and tag = 'structure_type'")
    assert {tuple(s["s"] for s in r["qualifier"]) for r in got.collect()} == {("app",)}


def test_whole_extraction(spark, die):
    lines = ["address,symbol", "0x1000,first", "0x1010,_Z4walkPN3app4NodeEi", "0x1020,_Z4makev", "0x1030,second", "0x1040,_Z5otherRN3app4NodeE", "0x1050,box", "0x1060,hidden", "0x1,unused", "zz,broken"]
    listing, audit = symbols.parse_listing(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"), address_column=0, symbol_column=1, skip=1)
    assert audit.count() == 1
    done = extract(die, listing, load.Config())
    types = {(r["kind"], r["name"]): r for r in done.types.collect()}
    node = types["struct", "app::Node"]
    assert sum(k[1] == "app::Node" for k in types) == 1, "one struct out of two units"
    members = [(m["offset"], m["name"], [t["op"] for t in m["ty"]], m["special"]) for m in node["members"]]
    assert [m[1] for m in members] == ["next", "id", "color", "more", "grid"]
    assert members[0][2] == ["base", "ptr"] and members[-1][2] == ["base", "arr", "arr"]
    derived = types["struct", "app::Derived"]
    assert [m["special"] for m in derived["members"]][0] == "base"
    assert [m["ty"][-1]["op"] for m in derived["members"]][-2:] == ["ptr", "ptmd"]
    assert ("struct_decl", "app::Hidden") in types and ("union", "app::Either") in types and ("enum", "app::Color") in types
    got = {r["link_name"]: r for r in done.symbols.collect()}
    assert got["_Z4walkPN3app4NodeEi"]["param_names"] == ["node", "a1"]
    assert got["_Z4walkPN3app4NodeEi"]["address"] == 0x1010
    assert [t["op"] for t in got["_Z5otherRN3app4NodeE"]["ty"]] == ["base", "base", "ptr", "sub"]
    assert ("struct", "app::Box<u32, 4>") in types
    counts = {r["kind"]: r["n"] for r in done.counts().collect()}
    assert counts["struct_decl"] == 1 and counts["union"] == 1 and counts["enum"] == 1
    assert {r["rule"] for r in done.violations.collect()} <= {"types differ"}


def test_template_arguments(die):
    got = load.template_args(die).collect()
    assert any([a["k"] for a in r["template_args"]] == ["type", "const"] and r["template_args"][1]["c"] == 4 for r in got)


def test_constructor_variants(spark):
    table = {"_ZN1SC2Ev": "S::S()", "_ZN1SC1Ev": "S::S()", "_ZN1SC3Ev": "S::S()", "_ZN1SD0Ev": "S::~S()", "_ZN1SD1Ev": "S::~S()", "_ZN1SD2Ev": "S::~S()", "_ZN1TD2Ev": "T::~T()", "_ZN1TD1Ev": "T::~T()", "_ZN1TD0Ev": "T::~T()"}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    read = lambda df, column, out: df.withColumn(out, F.coalesce(F.element_at(known, F.col(column)), F.col(column)))
    listing = spark.createDataFrame([("_ZN1SC2Ev", 16), ("_ZN1SD0Ev", 32), ("_ZN1TD2Ev", 48), ("plain", 64)], "symbol string, address long")
    got = {r["symbol"]: r["address"] for r in symbols.variants(listing, read).collect()}
    assert got == {"_ZN1SC2Ev": 16, "_ZN1SC1Ev": 16, "_ZN1SD0Ev": 32, "_ZN1TD2Ev": 48, "_ZN1TD1Ev": 48, "plain": 64}


def test_demangling_leaves_other_names(spark):
    if not (shutil.which("c++filt") or shutil.which("llvm-cxxfilt")):
        pytest.skip("no demangler")
    assert symbols.demangle_batch(["_ZN1SC1Ev", "main", "_Znonsense"])[:2] == ["S::S()", "main"]
    df = spark.createDataFrame([("_ZN1SC1Ev",), (None,)], "s string")
    assert {r["demangled"] for r in symbols.demangled(df, "s").collect()} == {"S::S()", None}


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[paths]\nelf = "x.elf"\n[extract]\npointer-width = 64\nptmf-repr = ["i64", 2]\n[extract.name-resolution]\nrules = ["^a", "<default>", "b$"]\ntest = [["a", "c"]]\n')
    own = config.load(path)
    assert own.elf == tmp_path / "x.elf" and own.loader.ptmf_repr == ("i64", 2)
    for bad in ("pointer-width = 24", 'ptmd-repr = "void"', 'vfptr-field-regex = "("', '[extract.name-resolution]\ntest = [["c", "c"]]'):
        path.write_text("[extract]\n" + bad + "\n")
        with pytest.raises(config.ConfigError):
            config.load(path)


def test_compile_commands(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('[{"file": "a.cpp", "command": "g++ -DX=\\"a b\\" -c a.cpp -o a.o"}, {"file": "a.cpp", "command": "g++ -I x -c a.cpp -o a.o -O2"}]')
    rows = config.read_compile_commands(spark, str(path)).collect()
    assert [(r["file"], r["arguments"]) for r in rows] == [("a.cpp", ["-I", "x", "-c", "a.cpp", "-o", "a.o", "-O2"])]
    assert config.parser_arguments(rows[0]["arguments"], source="p.cpp", output="p.json", depend="p.d") == ["-I", "x", "-O2", "-MD", "-MF", "p.d", "-o", "p.json", "p.cpp"]
    units = spark.createDataFrame([(0, "a.cpp"), (9, "b.cpp")], "cu_offset long, cu_name string")
    joined, missing = config.join_units(units, config.read_compile_commands(spark, str(path)))
    assert joined.count() == 1 and missing.first()["detail"] == "b.cpp"


def test_cache_computes_what_is_missing(spark, tmp_path):
    seen = []

    def compute(df):
        seen.append(sorted(r["k"] for r in df.collect()))
        return df.select("k", F.upper("k").alias("v"))

    for keys in (["a", "b"], ["b", "c"]):
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        got = cached(df, "k", str(tmp_path / "cache"), "k string, v string", compute)
        assert sorted((r["k"], r["v"]) for r in got.collect()) == [(k, k.upper()) for k in keys]
    assert seen == [["a", "b"], ["c"]]


def test_spellings_of_nested_templates(spark):
    from typeweave.operators.spelling import spellings

    tree = lambda ref, *ops: [("base", ref, None), *[(o, None, None) for o in ops]]
    rows = [
        (10, "Box", [("type", None, tree(1, "ptr")), ("const", 3, None)]),
        (11, "Pair", [("type", None, tree(10)), ("type", None, tree(2))]),
        (12, "Loop", [("type", None, tree(12))]),
        (13, "Empty", []),
    ]
    schema = "goff long, base string, template_args array<struct<k:string,c:bigint,ty:array<struct<op:string,ref:bigint,n:int>>>>"
    names = spark.createDataFrame([(1, "A"), (1, "B"), (2, "u8")], "goff long, name string")
    found, audit = spellings(spark.createDataFrame(rows, schema), names)
    got = {}
    for r in found.collect():
        got.setdefault(r["goff"], set()).add(r["name"])
    assert got == {10: {"Box<A*, 3>", "Box<B*, 3>"}, 11: {"Pair<Box<A*, 3>, u8>", "Pair<Box<B*, 3>, u8>"}}
    assert audit.count() == 0
