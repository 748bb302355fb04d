"""Encrypted restore maps.

Key: PBKDF2 with SHA-256, 390,000 rounds, 16 bytes of salt. Cipher: AES-256 in GCM mode by Spark's own
functions, so damage and wrong passwords are noticed. The envelope is JSON with its own format name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import tempfile
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.identity import ROW_KEY

SCHEMA_VERSION = 1
ROUNDS = 390_000
FORMAT = "veilspark-restore-map"
#: Entries of one restore file, which the driver makes.
MOST_ENTRIES = 100_000
#: Salts, that is calls of :func:`encrypt_each`, whose maps are opened together.
MOST_SALTS = 100


class MapError(ValueError):
    pass


def _key(passphrase: str, salt: bytes) -> bytes:
    passphrase = passphrase.strip()
    if not passphrase:
        raise MapError("a password is needed")
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ROUNDS, 32)


def encrypt(mapping: DataFrame, passphrase: str) -> bytes:
    """The envelope of a mapping (placeholder, entity_type, value; doc_id kept where present): one file, of at most ``MOST_ENTRIES``.

    For a corpus there is :func:`encrypt_each`.
    """
    spark = mapping.sparkSession
    salt = os.urandom(16)
    key = _key(passphrase, salt)
    rows = [r.asDict() for r in mapping.orderBy(*[c for c in ("doc_id", "placeholder") if c in mapping.columns]).limit(MOST_ENTRIES + 1).collect()]
    if len(rows) > MOST_ENTRIES:
        raise MapError(f"more than {MOST_ENTRIES} entries: encrypt each document's map by itself")
    payload = json.dumps({"schema_version": SCHEMA_VERSION, "created_at": datetime.now(timezone.utc).isoformat(), "entries": rows}, ensure_ascii=False).encode()
    sealed = spark.createDataFrame([(bytearray(payload), bytearray(key))], "p binary, k binary").select(F.aes_encrypt("p", "k", F.lit("GCM"))).first()[0]
    text = {"schema_version": SCHEMA_VERSION, "format": FORMAT, "kdf": "PBKDF2-HMAC-SHA256", "iterations": ROUNDS, "salt": base64.b64encode(salt).decode(), "token": base64.b64encode(bytes(sealed)).decode()}
    return json.dumps(text, indent=2).encode()


def _keys(spark: SparkSession, passphrase: str, salts: list[bytes]) -> DataFrame:
    """map_salt, map_key: rows of a relation, not literals, so that neither plan nor event log shows a key. One row for each salt, to be broadcast."""
    return F.broadcast(spark.createDataFrame([(bytearray(s), bytearray(_key(passphrase, s))) for s in salts], "map_salt binary, map_key binary"))


def _of_document(table: DataFrame) -> list[str]:
    found = [c for c in (ROW_KEY, "doc_id") if c in table.columns]
    if not found:
        raise MapError("a mapping of a whole corpus has no documents to seal: seal it as one file")
    return found


def encrypt_each(mapping: DataFrame, passphrase: str) -> DataFrame:
    """row_key and doc_id (what of them the mapping has), salt, token: the sealed map of each document, made where the rows are.

    One salt and key serve all maps of a call (deriving a key is made slow on purpose); every map has a nonce of its own.
    """
    salt = os.urandom(16)
    of = _of_document(mapping)
    entries = F.to_json(F.array_sort(F.collect_list(F.struct("placeholder", "entity_type", "value"))))
    made = mapping.groupBy(*of).agg(entries.alias("entries")).withColumn("salt", F.lit(bytearray(salt)))
    sealed = made.join(_keys(mapping.sparkSession, passphrase, [salt]), F.col("salt") == F.col("map_salt"))
    return sealed.select(*of, "salt", F.aes_encrypt(F.col("entries").cast("binary"), F.col("map_key"), F.lit("GCM")).alias("token"))


def decrypt_each(maps: DataFrame, passphrase: str) -> DataFrame:
    """row_key and doc_id (what of them the maps have), placeholder, entity_type, value; a map that does not open (wrong password, damage) is a row with nulls."""
    of = _of_document(maps)
    salts = [bytes(r.salt) for r in maps.select("salt").where("salt is not null").distinct().limit(MOST_SALTS + 1).collect()]
    if len(salts) > MOST_SALTS:
        raise MapError(f"maps of more than {MOST_SALTS} calls: open them call by call")
    opened = F.try_aes_decrypt("token", "map_key", F.lit("GCM")).cast("string")
    rows = F.from_json(opened, "array<struct<placeholder:string,entity_type:string,value:string>>")
    keyed = maps.join(_keys(maps.sparkSession, passphrase, salts), F.col("salt") == F.col("map_salt"), "left")
    return keyed.select(*of, F.explode_outer(rows).alias("e")).select(*of, "e.*")


def decrypt(spark: SparkSession, data: bytes, passphrase: str) -> list[dict]:
    try:
        text = json.loads(data)
        version, salt, token = text["schema_version"], base64.b64decode(text["salt"], validate=True), base64.b64decode(text["token"], validate=True)
    except (ValueError, KeyError, TypeError) as e:
        raise MapError("not a restore map") from e
    if version != SCHEMA_VERSION:
        raise MapError(f"unsupported version {version}")
    key = _key(passphrase, salt)
    try:
        opened = spark.createDataFrame([(bytearray(token), bytearray(key))], "t binary, k binary").select(F.try_aes_decrypt("t", "k", F.lit("GCM"))).first()[0]
    except PySparkException as e:
        raise MapError("wrong password or damaged map") from e
    if opened is None:
        raise MapError("wrong password or damaged map")
    return json.loads(bytes(opened))["entries"]


def write_private(path: str, data: bytes) -> None:
    """Whole or not at all, readable by the owner only."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(name, 0o600)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
