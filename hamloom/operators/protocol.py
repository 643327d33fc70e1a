"""Storing encrypted representatives and proving ownership, as columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hamloom.functions import crypto
from hamloom.functions.bits import hamming, word
from hamloom.functions.text import RECOVERY_DOMAIN, TAG_DOMAIN, simhash, text_tag, threshold_for

# Domains of the protocol's hashes; pass another system's to read what it stored.
RECORD, AAD, PROOF, WRAP, CHALLENGE = "record/v1", "aad/v1", "proof/v1:", "wrap/v1:", "ownership/v1"

STORED = T.StructType([T.StructField(n, t) for n, t in (("rid", T.StringType()), ("type", T.StringType()), ("tag", T.BinaryType()), ("helper", T.BinaryType()), ("vk", T.BinaryType()), ("nfile", T.BinaryType()), ("nwrap", T.BinaryType()), ("filekey", T.BinaryType()), ("wrapkey", T.BinaryType()), ("aad", T.BinaryType()))])


def _derived(seed: str, label: str, size: int) -> bytes:
    """Secrets from a seed, so that runs can be repeated; a deployment passes a secret seed."""
    return crypto.pad_stream(hashlib.sha256(f"{seed}/{label}".encode()).digest(), size)


def record_hash(rid: str, kind: str, tag: bytes, helper: bytes) -> bytes:
    return crypto.fields_hash(RECORD, rid.encode(), kind.encode(), tag, hashlib.sha256(helper).digest())


def _keys(r: bytes, rid: str, kind: str, tag: bytes, helper: bytes) -> tuple[bytes, bytes]:
    q = crypto.hkdf_extract(bytes(32), r)
    return q, crypto.hkdf_expand(q, (PROOF + record_hash(rid, kind, tag, helper).hex()).encode(), 32)


def first_upload(files: DataFrame, seed: str, keep: bool = False) -> DataFrame:
    """Encrypted representatives of files (rid, type, content binary); `keep` keeps the content beside them.

    Adds tag, helper, verification key, nonces, the file encrypted under a fresh key (cipher) and that key under one
    derived from the content's recovery representation (wrapped); both bind the record's other fields. Ciphers run in the JVM.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for rid, kind, content in zip(df["rid"], df["type"], df["content"], strict=True):
                if kind != "text":
                    raise ValueError(f"no adapter for type {kind!r}")
                tag, x = simhash(content, TAG_DOMAIN), simhash(content, RECOVERY_DOMAIN)
                r, helper = crypto.extract_new(x, _derived(seed, f"helper/{rid}", 90))
                q, proof = _keys(r, rid, kind, tag, helper)
                vk = crypto.public_key(proof)
                nfile, nwrap = _derived(seed, f"file/{rid}", 12), _derived(seed, f"wrap/{rid}", 12)
                aad = crypto.fields_hash(AAD, record_hash(rid, kind, tag, helper), vk, nfile, nwrap)
                wrap = crypto.hkdf_expand(q, (WRAP + hashlib.sha256(aad).hexdigest()).encode(), 32)
                out.append((rid, kind, tag, helper, vk, nfile, nwrap, _derived(seed, f"key/{rid}", 32), wrap, aad, content))
            yield pd.DataFrame(out, columns=[*STORED.fieldNames(), "content"])

    rows = files.select("rid", "type", "content").mapInPandas(make, T.StructType([*STORED.fields, T.StructField("content", T.BinaryType())]))
    gcm = lambda x, key, iv: F.aes_encrypt(x, key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.col("aad"))
    return rows.select("rid", "type", "tag", "helper", "vk", "nfile", "nwrap", "aad", gcm(F.col("content"), F.col("filekey"), F.col("nfile")).alias("cipher"), gcm(F.col("filekey"), F.col("wrapkey"), F.col("nwrap")).alias("wrapped"), *(["content"] if keep else []))


def challenge_message(uid: str, rid: str, kind: str, tag: bytes, helper: bytes, query_tag: bytes, token: bytes) -> bytes:
    return crypto.fields_hash(CHALLENGE, uid.encode(), record_hash(rid, kind, tag, helper), query_tag, token)


def prove(claims: DataFrame) -> DataFrame:
    """Claims (uid, content, token binary, and a stored record's rid, type, tag, helper, vk, ...) with proven and wrapkey.

    The key is extracted from the claimed content and the helper; if it leads to the record's verification key, the token is
    signed and the signature checked. proven is false where the content is too far away.
    """

    columns = ("uid", "content", "token", "rid", "type", "tag", "helper", "vk", "aad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proven, keys = [], []
            for uid, content, token, rid, kind, tag, helper, vk, aad in zip(*(b[c].to_pylist() for c in columns), strict=True):
                r = crypto.extract_again(simhash(content, RECOVERY_DOMAIN), helper)
                q, proof = _keys(r, rid, kind, tag, helper) if r is not None else (b"", b"")
                ok = r is not None and crypto.public_key(proof) == vk
                if ok:
                    m = challenge_message(uid, rid, kind, tag, helper, simhash(content, TAG_DOMAIN), token)
                    ok = crypto.verify(vk, m, crypto.sign(proof, m))
                proven.append(ok)
                keys.append(crypto.hkdf_expand(q, (WRAP + hashlib.sha256(aad).hexdigest()).encode(), 32) if ok else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(proven, pa.bool_()), pa.array(keys, pa.binary())], names=[*b.schema.names, "proven", "wrapkey"])

    return claims.mapInArrow(run, T.StructType([*claims.schema.fields, T.StructField("proven", T.BooleanType()), T.StructField("wrapkey", T.BinaryType())]))


def recover(proven: DataFrame, spec: str = "default=6") -> DataFrame:
    """Proven claims with `file`: the representative's content, or null where a key, nonce or bound field doesn't fit.

    What comes out must also have the stored tag, and the claimed content a tag within its type's distance of it.
    """
    gcm = lambda x, key: F.try_aes_decrypt(x, key, F.lit("GCM"), F.lit("DEFAULT"), F.col("aad"))
    opened = proven.withColumn("filekey", gcm(F.col("wrapped"), F.col("wrapkey"))).withColumn("file", gcm(F.col("cipher"), F.col("filekey"))).drop("filekey")
    tags = opened.withColumns({"_tag": F.lower(F.hex("tag")), "_file": text_tag("file", TAG_DOMAIN), "_own": text_tag("content", TAG_DOMAIN)})
    words = [[word(c, i) for i in range(4)] for c in ("_tag", "_own")]
    fits = (F.col("_file") == F.col("_tag")) & (hamming(*words) <= threshold_for("type", spec))
    return tags.withColumn("file", F.when(fits, F.col("file"))).drop("_tag", "_file", "_own")


def contains_all(policy: Column, attributes: Column) -> Column:
    """Whether every attribute of a policy is among the user's; an empty policy always is."""
    return F.size(F.array_except(policy, attributes)) == 0


def references(uploads: DataFrame) -> DataFrame:
    """(uid, rid, created): each user's references once, from the first time."""
    return uploads.groupBy("uid", "rid").agg(F.min("created").alias("created"))


def sampled_distance(stored: Column, claim: Column, samples: int, seed: int) -> Column:
    """Estimate of the differing bits of two 256-bit hex tags from `samples` positions: position i is the first byte of MD5 over
    the seed, a slash and i."""
    places = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), i.cast("string")).cast("binary")), 1, 2), 16, 10).cast("int"))

    def bit(tag: Column, p: Column) -> Column:
        digit = F.conv(F.substring(tag, (p / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
        return F.call_function("shiftright", digit, (3 - F.pmod(p, F.lit(4))).cast("int")).bitwiseAND(F.lit(1))

    wrong = F.aggregate(places, F.lit(0), lambda acc, p: acc + F.when(bit(stored, p) != bit(claim, p), 1).otherwise(0))
    return wrong * F.lit(256.0) / F.lit(float(samples))


def sampled_proof(pairs: DataFrame, samples: int, seed: int, most: float) -> DataFrame:
    """pairs (stored, claim: tags) with estimate and accepted: the estimated distance is at most `most`."""
    at = pairs.withColumn("estimate", sampled_distance(F.col("stored"), F.col("claim"), samples, seed))
    return at.withColumn("accepted", F.col("estimate") <= most)


def share_secret(secret: Column, names: Column, seed: str) -> Column:
    """Additive shares of a whole number below 2^31 - 1, one per name of a policy, that add up to it: a map from names to shares.

    All but the last are drawn from a hash of the seed and the name; a policy without names has no share.
    """
    prime = F.lit((1 << 31) - 1).cast("bigint")
    draw = lambda x: F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}/"), x).cast("binary"), 256), 1, 15), 16, 10).cast("bigint"), prime)
    names = F.array_sort(F.array_distinct(names))
    head = F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))
    drawn = F.transform(head, draw)
    rest = F.pmod(secret - F.aggregate(drawn, F.lit(0).cast("bigint"), lambda a, x: F.pmod(a + x, prime)), prime)
    return F.when(F.size(names) > 0, F.map_from_arrays(names, F.concat(drawn, F.array(rest)))).otherwise(F.create_map().cast("map<string,bigint>"))


def join_shares(shares: Column, attributes: Column) -> Column:
    """The secret of a policy's shares for a user with all its attributes; null if one is missing (an empty policy gives 0)."""
    prime = F.lit((1 << 31) - 1).cast("bigint")
    total = F.aggregate(F.map_values(shares), F.lit(0).cast("bigint"), lambda a, x: F.pmod(a + x, prime))
    return F.when(contains_all(F.map_keys(shares), attributes), total)


def transfer(rows: DataFrame, seed: str) -> DataFrame:
    """1-of-2 oblivious transfer for rows (ident string, first binary, second binary, choice int): adds received binary and sent bigint.

    The sender learns no choice, the receiver one message: keys are hashes of points of the curve of the signatures, of which the
    receiver can make the chosen one only. sent counts the bytes of both points and both ciphertexts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            got, sent = [], []
            for ident, a, b, choice in zip(df["ident"], df["first"], df["second"], df["choice"], strict=True):
                sender = crypto.transfer_offer(_derived(seed, f"sender/{ident}", 32))
                reply, key = crypto.transfer_choose(_derived(seed, f"receiver/{ident}", 32), sender[1], int(choice))
                keys = crypto.transfer_keys(sender, reply)
                boxes = [crypto.convergent(k, m) for k, m in zip(keys, (a, b), strict=True)]
                got.append(crypto.convergent(key, boxes[int(choice)]))
                sent.append(len(sender[1]) + len(reply) + sum(map(len, boxes)))
            yield df.assign(received=got, sent=sent)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("received", T.BinaryType()), T.StructField("sent", T.LongType())]))
