"""A registry of packs as tables: install, resolve, lock, verify, audit, repair, collect garbage."""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFLICT, INTEGRITY, INVALID, NOT_FOUND, OK, REVOKED, UNSUPPORTED, UNTRUSTED
from ..functions.native import let
from ..kernels import ed25519
from ..kernels.vocab import PackError
from ..plans.kernel import with_kernel

PACKS = "publisher string, name string, version string, sha256 string, size bigint, pack_class string, format string, trust_status string, key_id string"
KEY = ["publisher", "name", "version"]
_SEMVER = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"


def version(text: Column) -> Column:
    """struct(major, minor, patch), whose order is that of versions; null for anything else."""
    parts = [F.regexp_extract(text, _SEMVER, k).cast("bigint").alias(n) for k, n in ((1, "major"), (2, "minor"), (3, "patch"))]
    return F.when(text.rlike(_SEMVER), F.struct(*parts))


def satisfies(v: Column, constraint: Column) -> Column:
    """Whether a version struct meets all parts of a constraint: ^ >= <= > < == or a bare version.

    Null for a constraint that names no bound ('*', 'latest', '').
    """

    def one(part: Column) -> Column:
        op = F.regexp_extract(part, r"^(\^|>=|<=|==|>|<)?", 1)
        base = version(F.trim(F.regexp_replace(part, r"^(\^|>=|<=|==|>|<)", "")))

        def against(b: Column) -> Column:
            # below the next version at the first place that isn't zero, or at the last
            parts = F.array(*[b[k].cast("bigint") for k in ("major", "minor", "patch")])
            place = F.coalesce(F.nullif(F.array_position(F.transform(parts, lambda x: x != 0), True), F.lit(0)), F.lit(3))
            upper = F.transform(parts, lambda x, i: F.when(i + 1 < place, x).when(i + 1 == place, x + 1).otherwise(F.lit(0).cast("bigint")))
            caret = (v >= b) & (F.array(*[v[k].cast("bigint") for k in ("major", "minor", "patch")]) < upper)
            return F.when(op == "^", caret).when(op == ">=", v >= b).when(op == "<=", v <= b).when(op == ">", v > b).when(op == "<", v < b).otherwise(v == b)

        return let(base, against)

    parts = F.filter(F.transform(F.split(constraint, ","), lambda p: F.trim(p)), lambda p: p != "")
    open_ended = F.trim(constraint).isin("", "*", "latest")
    return F.when(~open_ended, F.forall(parts, one))


def install(registry: DataFrame, packs: DataFrame) -> DataFrame:
    """registry with new packs. A name and version never changes its content: status 8.

    Rows that are there already are left alone, so that installing twice is installing once.
    """
    new = packs.dropDuplicates()
    if not new.where(version(F.col("version")).isNull() | (F.coalesce("publisher", F.lit("")) == "") | F.contains("publisher", F.lit("/")) | (F.coalesce("name", F.lit("")) == "") | F.contains("name", F.lit("/"))).isEmpty():
        raise PackError("a publisher, name or version isn't valid", INVALID)
    both = registry.select(*KEY, "sha256").unionByName(new.select(*KEY, "sha256"))
    if not both.groupBy(*KEY).agg(F.countDistinct("sha256").alias("n")).where("n > 1").isEmpty():
        raise PackError("a version has other content", CONFLICT)
    return registry.unionByName(new.join(registry.select(*KEY), KEY, "left_anti"))


def resolve(registry: DataFrame, requirements: DataFrame) -> DataFrame:
    """(role, pack columns) of the highest version, then hash, that meets each requirement.

    requirements: (role, publisher, name, constraint). A role twice, a constraint without a bound
    (status 1) or one that no pack meets (status 11) fails the whole. Versions of a pack are compared
    before they are shuffled, so that a pack of many versions is no hot group.
    """
    bound = satisfies(version(F.lit("1.0.0")), F.col("constraint")).isNotNull()
    if not requirements.groupBy("role").agg(F.count("*").alias("n"), F.min(bound).alias("bound")).where("n > 1 or not bound").isEmpty():
        raise PackError("a role is there twice or a constraint has no bound", INVALID)
    fits = requirements.join(registry, ["publisher", "name"]).where(satisfies(version(F.col("version")), F.col("constraint")))
    order = F.struct(version(F.col("version")), "sha256")
    best = fits.groupBy("role").agg(F.max_by(F.struct(*registry.columns), order).alias("pack")).select("role", "pack.*")
    if not requirements.join(best.select("role"), "role", "left_anti").isEmpty():
        raise PackError("a requirement can't be met", NOT_FOUND)
    return best


def _canonical(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def catalog_tree(registry: DataFrame, digits: int = 3) -> DataFrame:
    """(bucket, n, digest): rows by the first hexadecimal digits of their own digest.

    A row's digest is SHA-256 of its columns as JSON in the order of their names; a bucket's is that
    of its rows' digests in order. More digits for more than some hundred million rows.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(registry.columns)), {"ignoreNullFields": "false"}), 256)
    rows = registry.select(row.alias("h")).groupBy(F.substring("h", 1, digits).alias("bucket"))
    return rows.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def catalog_root(registry: DataFrame, digits: int = 3) -> DataFrame:
    """(n, catalog_sha256) of a catalog: one row, the same for any order and partitioning of its rows."""
    tree = catalog_tree(registry, digits)
    line = F.concat_ws(":", "bucket", "digest")
    return tree.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("catalog_sha256"))


def catalog_hash(registry: DataFrame) -> str:
    """The hash alone; the driver sees nothing but it."""
    return catalog_root(registry).first().catalog_sha256


def lock(registry: DataFrame, requirements: DataFrame) -> dict:
    """The lock of resolved requirements, with the catalog's hash and its own."""
    rows = [r.asDict() for r in resolve(registry, requirements).orderBy("role").collect()]
    base = {"schema": 1, "catalog_sha256": catalog_hash(registry), "packs": rows}
    return {**base, "lock_sha256": hashlib.sha256(_canonical(base)).hexdigest()}


def verify_lock(lock: dict, objects: DataFrame) -> list[str]:
    """What is wrong with a lock; objects: (sha256, content_sha256) of the stored files."""
    errors = [] if lock.get("schema") == 1 else ["bad schema"]
    base = {k: v for k, v in lock.items() if k != "lock_sha256"}
    if hashlib.sha256(_canonical(base)).hexdigest() != lock.get("lock_sha256"):
        errors.append("lock hash mismatch")
    roles = [p["role"] for p in lock.get("packs", [])]
    errors += [f"duplicate role {r}" for r in sorted({r for r in roles if roles.count(r) > 1})]
    wanted = [p["sha256"] for p in lock.get("packs", [])]
    have = dict(objects.where(F.col("sha256").isin(wanted)).select("sha256", "content_sha256").collect()) if wanted else {}
    errors += [f"missing object {h}" for h in wanted if h not in have]
    return errors + [f"corrupt object {h}" for h in wanted if have.get(h, h) != h]


def stored_objects(files: DataFrame) -> DataFrame:
    """(sha256, content_sha256, size) of a binaryFile table whose files are named by their hash."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("sha256"), F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("size"))


def audit(registry: DataFrame, objects: DataFrame) -> DataFrame:
    """(publisher, name, version, problem) of packs whose object is missing or corrupt."""
    joined = registry.join(objects.withColumnRenamed("size", "stored"), "sha256", "left")
    problem = F.when(F.col("content_sha256").isNull(), "missing").when((F.col("stored") != F.col("size")) | (F.col("content_sha256") != F.col("sha256")), "corrupt")
    return joined.select(*KEY, problem.alias("problem")).where("problem is not null")


def repairable(registry: DataFrame, objects: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered (sha256, content) files that a pack needs and that aren't whole in the store."""
    whole = objects.where("sha256 = content_sha256")
    good = offered.where(F.sha2("content", 256) == F.col("sha256"))
    return good.join(registry.select("sha256").distinct(), "sha256", "left_semi").join(whole.select("sha256"), "sha256", "left_anti")


def garbage(registry: DataFrame, objects: DataFrame) -> DataFrame:
    """(sha256) of stored objects that no pack names."""
    return objects.select("sha256").join(registry.select("sha256").distinct(), "sha256", "left_anti")


# The record of a signature.
SIGNATURE_MAGIC, SIGNATURE_SIZE, ED25519 = b"MSSIGV01", 160, 1
# End of fixed values.
#: What our own signatures are over, before the key's id and the pack's hash; a parameter.
TRUST_DOMAIN = b"glyphline-pack-signature-v1"
_HEAD = struct.Struct("<8sIIII32s32s64s8s")


def key_id(public: bytes) -> bytes:
    return hashlib.sha256(public).digest()


def signature_record(seed: bytes, pack_sha256: bytes, domain: bytes = TRUST_DOMAIN) -> bytes:
    """The record that says that a key has signed a pack's hash."""
    own = key_id(ed25519.public_key(seed))
    return _HEAD.pack(SIGNATURE_MAGIC, 1, SIGNATURE_SIZE, 0, ED25519, own, pack_sha256, ed25519.sign(seed, domain + own + pack_sha256), bytes(8))


def _trusted(domain: bytes):
    def fn(data):
        sha, revoked, public, record = data[:32], data[32], data[33:65], data[65:]
        if len(record) != SIGNATURE_SIZE:
            return (INVALID,)
        magic, version_, size, zero, algorithm, own, signed, signature, rest = _HEAD.unpack(record)
        if (magic, version_, size, zero, algorithm, rest) != (SIGNATURE_MAGIC, 1, SIGNATURE_SIZE, 0, ED25519, bytes(8)) or signed != sha:
            return (INTEGRITY,)
        if revoked == 2 or key_id(public) != own:  # no such key
            return (UNTRUSTED,)
        if revoked:
            return (REVOKED,)
        return (OK if ed25519.verify(public, domain + own + sha, signature) else UNTRUSTED,)

    return fn


def trust(registry: DataFrame, keys: DataFrame, domain: bytes = TRUST_DOMAIN) -> DataFrame:
    """registry, which has a column ``signature``, with trust_code.

    keys: (key_id in hex, public_key binary, revoked). Codes: 10 without a signature, 1 and 12 for a
    record that isn't one or is another pack's, 14 for an unknown key or a wrong signature, 15 for a
    revoked key, and 0 only where the signature was verified.
    """
    names = registry.columns
    known = keys.select(F.lower("key_id").alias("__key"), F.col("public_key").alias("__public"), F.col("revoked").cast("int").alias("__revoked"))
    rows = registry.withColumn("__key", F.lower(F.hex(F.substring("signature", 25, 32)))).join(known, "__key", "left")
    flag = F.unhex(F.lpad(F.hex(F.coalesce("__revoked", F.lit(2)).cast("bigint")), 2, "0"))
    public = F.coalesce("__public", F.lit(bytearray(32)))
    rows = rows.withColumn("__data", F.when(F.col("signature").isNotNull(), F.concat(F.unhex("sha256"), flag, public, "signature")))
    out = with_kernel(rows, "__data", "trust_code int", _trusted, domain)
    return out.select(*names, F.coalesce("trust_code", F.lit(UNSUPPORTED)).alias("trust_code"))
