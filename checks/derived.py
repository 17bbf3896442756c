"""Stage tables derived from the test tables by SQL that Spark and DuckDB both run.

Table names stand in braces; ``for_spark`` binds them to DataFrames and ``for_duckdb``
to the registered views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

ROW_ID = (
    "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', "
    "CAST(round(l_extendedprice * 100) AS BIGINT))"
)


def for_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t for t in TABLES if "{" + t + "}" in sql}
    text = sql.replace("{", "{{").replace("}", "}}")  # braces inside literals stay as they are
    for t in used:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


_PART_BYTES = 2 << 20  # of a file, which queries expand many times over


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Each is one file with one row group, which Spark cannot split, so its
    rows are spread over the cores here, in more parts the larger the file is; tables of many
    files are read as they are."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return df.repartition(max(cores, -(-size // _PART_BYTES)))


def for_duckdb(sql: str) -> str:
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", sql)


# index, algorithm, family, primitive of the derived assets
_KINDS = """
(0,'RSA','RSA','ASYMMETRIC_ENCRYPTION'), (1,'RSA','RSA','DIGITAL_SIGNATURE'), (2,'AES','AES','SYMMETRIC_CIPHER'),
(3,'AES-128-CBC','AES','SYMMETRIC_CIPHER'), (4,'SHA-256','SHA','HASH_FUNCTION'), (5,'SHA-1','SHA','HASH_FUNCTION'),
(6,'MD5','MD5','HASH_FUNCTION'), (7,'SHA-512','SHA','HASH_FUNCTION'), (8,'SHA-3','SHA','HASH_FUNCTION'),
(9,'SHA-224','SHA','HASH_FUNCTION'), (10,'ECDSA','ECC','DIGITAL_SIGNATURE'), (11,'ECDH','ECC','KEY_EXCHANGE'),
(12,'Ed25519','ECC','DIGITAL_SIGNATURE'), (13,'DH','DH','KEY_EXCHANGE'), (14,'DSA','DSA','DIGITAL_SIGNATURE'),
(15,'3DES','3DES','SYMMETRIC_CIPHER'), (16,'DES','DES','SYMMETRIC_CIPHER'), (17,'RC4','RC4','SYMMETRIC_CIPHER'),
(18,'ChaCha20','CHACHA20','SYMMETRIC_CIPHER'), (19,'HMAC','HMAC','MAC'), (20,'HMAC-SHA1','HMAC','MAC'),
(21,'HMAC-SHA384','HMAC','MAC'), (22,'PBKDF2','PBKDF2','KDF'), (23,'bcrypt','BCRYPT','KDF'),
(24,'Argon2','ARGON2','KDF'), (25,'scrypt','SCRYPT','KDF'), (26,'HKDF','HKDF','KDF'), (27,'TLS','TLS','PROTOCOL'),
(28,'SSL','SSL','PROTOCOL'), (29,'ML-KEM','ML-KEM','KEY_EXCHANGE'), (30,'ML-DSA','ML-DSA','DIGITAL_SIGNATURE'),
(31,'SLH-DSA','SLH-DSA','DIGITAL_SIGNATURE'), (32,'Library: OpenSSL','LIBRARY','LIBRARY'), (33,'CSPRNG','RANDOM','RANDOM'),
(34,'X.509 Certificate','CERTIFICATE','CERTIFICATE'), (35,'RSA','RSA','KEY_MATERIAL'),
(36,'Cryptographic Key Material','KEY_MATERIAL','KEY_MATERIAL'), (37,'Unknown Algorithm',NULL,'UNKNOWN'),
(38,'Poly1305','POLY1305','MAC'), (39,'CMAC','CMAC','MAC'), (40,'Blowfish','BLOWFISH','SYMMETRIC_CIPHER'),
(41,'ElGamal','ELGAMAL','ASYMMETRIC_ENCRYPTION'), (42,'PBKDF2-MD5','PBKDF2','KDF'),
(43,'RIPEMD-160','RIPEMD','HASH_FUNCTION'), (44,'SHA-384','SHA','HASH_FUNCTION'), (45,'ECDSA','ECC','KEY_MATERIAL'),
(46,'Twofish','TWOFISH','SYMMETRIC_CIPHER'), (47,'Whirlpool','WHIRLPOOL','HASH_FUNCTION')
"""

ASSET_FACTS = f"""
SELECT {ROW_ID} AS asset_id,
       v.algorithm, v.algorithm_family, v.primitive_type,
       CASE l_orderkey % 9 WHEN 0 THEN 128 WHEN 1 THEN 192 WHEN 2 THEN 256 WHEN 3 THEN 512 WHEN 4 THEN 1024
            WHEN 5 THEN 2048 WHEN 6 THEN 3072 WHEN 7 THEN 4096 END AS key_length_bits,
       CASE l_suppkey % 6 WHEN 0 THEN 'secp256r1' WHEN 1 THEN 'secp384r1' WHEN 2 THEN 'secp521r1'
            WHEN 3 THEN 'mystery1' END AS curve,
       CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'ECB' WHEN 1 THEN 'GCM' WHEN 2 THEN 'CBC' WHEN 3 THEN 'ctr' END AS mode,
       CASE l_orderkey % 4 WHEN 0 THEN 'PKCS1v15' WHEN 1 THEN 'PSS' WHEN 2 THEN 'PKCS1_OAEP' END AS padding,
       CASE l_orderkey % 5 WHEN 0 THEN 'OpenSSL' WHEN 1 THEN 'hashlib' WHEN 2 THEN 'javax.crypto' END AS implementation_library,
       CASE l_suppkey % 11 WHEN 0 THEN concat('top', l_partkey % 3, '.py')
            ELSE concat('/src', l_suppkey % 7, '/mod', l_partkey % 50, '.py') END AS file_path,
       CASE WHEN l_linenumber < 7 THEN CAST(l_orderkey % 400 + 1 AS INT) END AS start_line,
       round(0.1 + l_discount * 8, 4) AS confidence_score,
       CASE WHEN l_orderkey % 7 < 5 THEN l_linenumber * 3 + 0.5 * (l_suppkey % 3) - 2.5 END AS x_years,
       CASE WHEN l_suppkey % 4 = 0 THEN 2.5E0 END AS y_years,
       CASE WHEN l_partkey % 5 = 0 THEN 12.0E0 END AS z_years,
       CASE l_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS hndl_sensitive
FROM {{lineitem}} JOIN (VALUES {_KINDS}) AS v(i, algorithm, algorithm_family, primitive_type) ON v.i = l_partkey % 48
"""

FINDING_FACTS = f"""
SELECT {ROW_ID} AS finding_id,
       l_orderkey AS emit_seq,
       concat('src', l_suppkey % 10, '/mod', l_partkey % 50, '.py') AS file_path,
       CAST(l_orderkey % 400 + 1 AS INT) AS start_line,
       CASE l_returnflag WHEN 'A' THEN 'AST' WHEN 'N' THEN 'REGEX' ELSE 'API_CALL' END AS discovery_method,
       CASE l_suppkey % 3 WHEN 0 THEN 'Repository/Python' WHEN 1 THEN 'Repository/Java' ELSE 'Binary/Strings' END AS scanner_name,
       CASE l_partkey % 14 WHEN 0 THEN 'RSA' WHEN 1 THEN 'aes-256-gcm' WHEN 2 THEN 'AES_128_CBC' WHEN 3 THEN 'sha256'
            WHEN 4 THEN 'MD5' WHEN 5 THEN 'ecdsa' WHEN 6 THEN 'x25519' WHEN 7 THEN '3DES' WHEN 8 THEN 'hmac'
            WHEN 9 THEN 'PBKDF2' WHEN 10 THEN 'kyber' WHEN 11 THEN 'tlsv1' WHEN 12 THEN 'des' ELSE 'SHA512' END AS suspected_algorithm,
       CASE l_partkey % 14 WHEN 0 THEN 'ASYMMETRIC_PKC' WHEN 3 THEN 'HASH_FUNCTION' WHEN 4 THEN 'HASH_FUNCTION'
            WHEN 5 THEN 'DIGITAL_SIGNATURE' WHEN 6 THEN 'KEY_EXCHANGE' WHEN 8 THEN 'MAC' WHEN 9 THEN 'KDF'
            WHEN 10 THEN 'KEY_EXCHANGE' WHEN 11 THEN 'PROTOCOL' WHEN 13 THEN 'HASH_FUNCTION' ELSE 'SYMMETRIC_CIPHER' END AS artifact_category,
       CASE WHEN l_partkey % 14 = 0 THEN CASE l_linenumber % 4 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 4096 END END AS key_size_hint,
       CASE WHEN l_partkey % 14 = 5 THEN CASE l_suppkey % 3 WHEN 0 THEN 'prime256v1' WHEN 1 THEN 'secp384r1' END END AS curve_hint,
       CASE l_suppkey % 5 WHEN 0 THEN 'hashlib' WHEN 1 THEN 'libssl3-dev' END AS library_hint,
       round(0.4 + l_tax * 5, 4) AS confidence_score
FROM {{lineitem}}
"""


def asset_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_spark(spark, sf_dir, ASSET_FACTS)


def finding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_spark(spark, sf_dir, FINDING_FACTS)


def timeline_inputs(facts: DataFrame) -> DataFrame:
    return facts.selectExpr(
        "asset_id", "y_years AS migration_time_years", "z_years AS quantum_arrival_years",
        "x_years AS protected_lifetime_years", "hndl_sensitive", "CAST(NULL AS DATE) AS assessment_date",
    ).where("y_years IS NOT NULL OR z_years IS NOT NULL OR x_years IS NOT NULL OR hndl_sensitive IS NOT NULL")


def with_location(facts: DataFrame) -> DataFrame:
    """Facts in the shape of a stage table: place as a struct."""
    return facts.selectExpr(
        "*",
        "named_struct('file_path', file_path, 'start_line', start_line, 'end_line', CAST(NULL AS INT), "
        "'byte_offset', CAST(NULL AS BIGINT), 'snippet', CAST(NULL AS STRING)) AS location",
    ).drop("file_path", "start_line")
