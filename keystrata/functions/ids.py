"""Name-based (version 5) UUIDs as a column expression."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSET_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "asset.keystrata")
FINDING_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "finding.keystrata")


def uuid_v5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5 UUID of ``name``: SHA-1 over namespace and name, cut to
    128 bits, with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    # variant: the two top bits of the 17th hex digit become 10
    variant = F.substring(F.lit("89ab"), _variant_index(digest), F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def _variant_index(digest: Column) -> Column:
    nibble = F.instr(F.lit("0123456789abcdef"), F.substring(digest, 17, 1)) - 1
    return (nibble % 4 + 1).cast("int")


def asset_uuid(
    path: Column, line: Column, algorithm: Column, key: Column, mode: Column, curve: Column, library: Column
) -> Column:
    """Stable asset identity from where it is and what it is."""
    def part(label: str, value: Column, fill: str = "none") -> Column:
        return F.concat(F.lit(f"{label}:"), F.coalesce(value, F.lit(fill)))

    blank = lambda c: F.when(c != "", c)
    seed = F.concat_ws(
        "|",
        part("path", path),
        part("line", line.cast("string"), "file"),
        part("alg", F.upper(algorithm)),
        part("key", F.when(key != 0, key.cast("string"))),
        part("mode", F.upper(blank(mode)), "NONE"),
        part("curve", F.lower(blank(curve))),
        part("lib", F.lower(blank(library))),
    )
    return uuid_v5(ASSET_NAMESPACE, seed)
