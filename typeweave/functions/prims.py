"""The primitive types: names, C++ spellings, sizes, ids, and how debug information encodes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIM_BASE = 0x1FFFF0000

# Fixed values: (name, C++ name, byte size or None, id above PRIM_BASE).
PRIMITIVES = [
    ("void", "void", None, 0x0000),
    ("bool", "bool", 1, 0x0001),
    ("u8", "uint8_t", 1, 0x0101),
    ("u16", "uint16_t", 2, 0x0102),
    ("u32", "uint32_t", 4, 0x0104),
    ("u64", "uint64_t", 8, 0x0108),
    ("u128", "uint128_t", 16, 0x0110),
    ("i8", "int8_t", 1, 0x0201),
    ("i16", "int16_t", 2, 0x0202),
    ("i32", "int32_t", 4, 0x0204),
    ("i64", "int64_t", 8, 0x0208),
    ("i128", "int128_t", 16, 0x0210),
    ("f32", "float32_t", 4, 0x0304),
    ("f64", "float64_t", 8, 0x0308),
    ("f128", "float128_t", 16, 0x0310),
]

# Fixed values: (encoding, byte size, primitive).
ENCODINGS = [
    ("boolean", 1, "bool"),
    ("unsigned", 1, "u8"),
    ("unsigned_char", 1, "u8"),
    ("signed", 1, "i8"),
    ("signed_char", 1, "i8"),
    ("unsigned", 2, "u16"),
    ("signed", 2, "i16"),
    ("UTF", 2, "u16"),
    ("unsigned", 4, "u32"),
    ("signed", 4, "i32"),
    ("float", 4, "f32"),
    ("unsigned", 8, "u64"),
    ("signed", 8, "i64"),
    ("float", 8, "f64"),
    ("unsigned", 16, "u128"),
    ("signed", 16, "i128"),
    ("float", 16, "f128"),
]

PRIM_ID = {name: PRIM_BASE + code for name, _, _, code in PRIMITIVES}
CPP_NAME = {name: cpp for name, cpp, _, _ in PRIMITIVES}
BYTE_SIZE = {name: size for name, _, size, _ in PRIMITIVES}


def primitive_table(spark: SparkSession) -> DataFrame:
    """(goff, prim, cpp_name, byte_size): the fixed dimension of 15 rows."""
    rows = [(PRIM_ID[n], n, cpp, size) for n, cpp, size, _ in PRIMITIVES]
    return spark.createDataFrame(rows, "goff long, prim string, cpp_name string, byte_size int")


def encoding_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENCODINGS, "encoding string, byte_size long, prim string")


def is_prim(goff: Column) -> Column:
    """Whether an id is one of the fifteen primitives'."""
    return goff.isin(*PRIM_ID.values())


def decode_primitives(base_types: DataFrame) -> DataFrame:
    """base_types (encoding, byte_size) with prim; an unknown pair keeps null, which audits report."""
    return base_types.join(F.broadcast(encoding_table(base_types.sparkSession)), ["encoding", "byte_size"], "left")
