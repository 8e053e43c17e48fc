"""Secret scans: candidates from words, and a random forest that removes false positives."""

from __future__ import annotations

import base64
import hashlib
import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, row_key

#: What splits a word into runs and the gaps between them; '=' and ':' are gaps. Words with a key may hold more in a run.
RUN_CHARS = r"A-Za-z0-9+/_.@\-"
NARROW, WIDE = f"[{RUN_CHARS}]+|[^{RUN_CHARS}]+", f"[{RUN_CHARS}!#$%^*~]+|[^{RUN_CHARS}!#$%^*~]+"
#: A run that may be a secret on its own, and the least characters of one that a key names.
RUN, SHORTEST = f"[{RUN_CHARS}]{{12,}}", 4
#: Stems of words that name a secret just before it.
KEY_STEMS = "token|secret|passw|pwd|api_?-?key|access_?-?key|private_?-?key|credential|bearer|auth"
#: What stands between a name and its value, at the end of the text before the value.
ASSIGNS = r"(?:[\"'`]?\s*(?::=|=>|[:=])\s*[\"'`(]*|>)$"
#: The text before a value that a key names: key = "value, key: value, --key value, <key>value, Bearer value, //user:value@host.
KEYED = rf"(?i)(?:(?:{KEY_STEMS})[A-Za-z0-9_.\-]*{ASSIGNS}|--?[A-Za-z0-9_\-]*(?:{KEY_STEMS})[A-Za-z0-9_\-]*\s$|(?:bearer|basic)\s$)"
USERINFO = r"://?[^/\s:@]*:$|//[^/\s:@]+:$"
NAMES, USER_IN_URL = rf"(?i)(?:{KEY_STEMS})", r"//[^/\s:@]*:[^/\s@]+@"
#: Where a text comes from, as its source or path says.
CONFIG_PATH, SAMPLE_PATH = r"(?i)\.(?:env|ya?ml|json|ini|toml|properties|conf|cfg|pem|key|tfvars)$|config|secret", r"(?i)test|example|sample|fixture|mock|demo|doc"
#: Evidence for weak labels, of the value alone and no feature: formats of known keys, harmless formats, hash lengths.
KNOWN_KEYS = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{60,}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})$"
HARMLESS = r"^(?:[^@/]+@[^@/]+\.[A-Za-z]+|[0-9]+(?:\.[0-9]+){3}|[0-9./+-]+|[A-Z]?[a-z]+|[A-Z]+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}T.*|[_=.*-]+)\.?$"
HASHES = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
HASH_NAMES = r"(?i)(?:commit|sha-?[0-9]+|md5|checksum|digest|etag|integrity|revision)[^A-Za-z]*$"
#: A value of at least so many characters and bits of entropy a character looks random.
RANDOM_CHARS, RANDOM_BITS = 20, 3.0
#: A dictionary word occurs in at least so many documents.
DICTIONARY_DOCS = 5
#: Findings learned from, at most about: the documented bound of the training sample.
TRAIN_FINDINGS = 20_000
TREES, DEPTH, SEED = 24, 6, 7
FEATURES = ["length", "transitions", "digit_share", "upper_share", "hex_share", "distinct_share", "mean_bigram", "dictionary_share", "slashes", "dots", "at_sign", "quoted", "key_before", "assigned", "names_next", "prev_letters", "next_letters", "path_config", "path_sample"]
CLASS_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CLASS_TO = "a" * 26 + "A" * 26 + "0" * 10


def with_neighbours(rows: DataFrame, back: int) -> DataFrame:
    """``rows`` with ``around``: each of ``items`` with the ``back`` items before it and the one after, empty at the ends.

    Shifted copies side by side, as an index into the array makes the engine split the text again for each item.
    """
    items = F.col("items")
    shifted = {f"before{k}": F.concat(F.array_repeat(F.lit(""), k), items) for k in range(1, back + 1)}
    shifted["after"] = F.concat(F.slice(items, 2, F.greatest(F.array_size(items) - 1, F.lit(0))), F.array(F.lit("")))
    zipped = F.arrays_zip(items, *shifted.values())
    named = lambda z: F.struct(*[z["items" if k == 0 else str(k)].alias(name) for k, name in enumerate(["items", *shifted])])
    return rows.withColumn("around", F.slice(zipped, 1, F.greatest(F.array_size(items), F.lit(0)))).withColumn("around", F.transform("around", named))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, word_no, run_no, value, quoted, left, next, before, after, source)``: every run that may be a secret, with what stands around it.

    Words are delimited by blanks and numbered from 1 over the whole text, runs and gaps from 1 within a word. All
    runs of 12 characters count, with or without a digit, and every run of at least ``SHORTEST`` that a key names.
    ``left`` is the text just before a run: three pieces of its own word, and the two words before where these
    reach the start of the word. ``source`` is empty in tables without such a column.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), source.alias("source"))
    own = own.withColumn("named", F.col("text").rlike(f"{NAMES}|{USER_IN_URL}")).where(F.col("text").rlike(RUN) | F.col("named"))
    words = with_neighbours(own.select("doc_id", "source", "named", F.split("text", r"\s+").alias("items")), 2)
    lead = lambda w: F.concat_ws(" ", w["before2"], w["before1"], F.lit(""))
    keyed = lambda w: F.col("named") & ((w["items"].rlike(NAMES) & w["items"].rlike("[:=>]")) | w["items"].rlike(USER_IN_URL) | lead(w).rlike(KEYED))
    word = lambda w, i: F.when((F.length(w["items"]) >= SHORTEST) & (w["items"].rlike(RUN) | keyed(w)), F.struct((i + 1).cast("long").alias("word_no"), w["items"].alias("word"), w["before1"].alias("before"), lead(w).alias("lead"), w["after"].alias("after"), keyed(w).alias("keyed")))
    hits = words.select("doc_id", "source", F.explode(F.filter(F.transform("around", word), lambda w: w.isNotNull())).alias("c")).select("doc_id", "source", "c.*")
    cut = with_neighbours(hits.withColumn("items", F.when(F.col("keyed"), F.regexp_extract_all("word", F.lit(WIDE), F.lit(0))).otherwise(F.regexp_extract_all("word", F.lit(NARROW), F.lit(0)))), 3)
    left = lambda p, i: F.concat(F.when(i < 3, F.col("lead")).otherwise(F.lit("")), p["before3"], p["before2"], p["before1"])
    long = lambda p: (F.length(p) >= 12) | (F.col("keyed") & (F.length(p) >= SHORTEST))
    part = lambda p, i: F.when(p["items"].rlike(f"^[{RUN_CHARS}!#$%^*~]") & long(p["items"]), F.struct((i + 1).cast("long").alias("run_no"), p["items"].alias("run"), left(p, i).alias("left"), p["before1"].alias("gap"), p["after"].alias("next")))
    runs = cut.select("doc_id", "source", "word_no", "before", "after", F.explode(F.filter(F.transform("around", part), lambda r: r.isNotNull())).alias("r")).select("doc_id", "source", "word_no", "r.*", "before", "after")
    user = F.col("left").rlike(USERINFO) & F.col("run").contains("@")
    value = F.when(user, F.regexp_extract("run", "^(.*)@", 1)).otherwise(F.regexp_replace("run", r"^\.+|[.!]+$", ""))
    found = runs.select("doc_id", "word_no", "run_no", value.alias("value"), F.concat("gap", "next").rlike(r"""["'`]""").alias("quoted"), "left", F.concat_ws(" ", "next", F.when(F.col("next") == "", F.col("after"))).alias("next"), "before", "after", "source", user.alias("user"))
    return found.where((F.length("value") >= 12) | ((F.length("value") >= SHORTEST) & (F.col("user") | F.col("left").rlike(KEYED)))).drop("user")


def dictionary(docs: DataFrame, text_col: str, least_docs: int = DICTIONARY_DOCS) -> DataFrame:
    """``(word, docs)``: lower-case words of letters that occur in at least ``least_docs`` rows, over all rows."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+"))).alias("word"))
    return words.where(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)


def letter_transitions(words: DataFrame) -> dict[str, float]:
    """Log-probability of each pair of neighbouring letters a-z in dictionary words: at most 676 numbers."""
    pairs = words.select("docs", F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), i -> substring(word, i, 2))")).alias("pair"))
    counted = pairs.where(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").agg(F.sum("docs").alias("n"))
    found = {r["pair"]: r["n"] for r in counted.collect()}
    total = sum(found.values()) + 676
    return {pair: math.log((n + 1) / total) for pair, n in sorted(found.items())}


def with_features(found: DataFrame, words: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """``found`` with the columns of ``FEATURES`` and with ``entropy``, bits a character, which only labels read.

    Dictionary coverage joins the letter runs of the distinct values with the dictionary. A value that fills a
    third of the findings is one row there.
    """
    value = F.col("value")
    values = found.select("value").distinct()
    parts = values.select("value", F.explode(F.filter(F.split(F.lower(value), r"[^\p{L}]+"), lambda p: F.length(p) >= 3)).alias("word"))
    covered = parts.join(words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    low = F.lower(value)
    shape = F.translate(value, CLASS_FROM, CLASS_TO)
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / F.length(value)
    letters = F.regexp_replace(low, "[^a-z]+", "")
    worst = min(pairs.values(), default=0.0) - 1.0
    known = F.create_map(*[F.lit(x) for item in pairs.items() for x in item]) if pairs else F.create_map(F.lit(""), F.lit(0.0))
    steps = F.transform(F.sequence(F.lit(1), F.length("letters") - 1), lambda i: F.coalesce(F.element_at(known, F.substring(F.col("letters"), i, F.lit(2))), F.lit(worst)))
    mean = F.when(F.length("letters") >= 2, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (F.length("letters") - 1)).otherwise(worst)
    part = lambda c: F.when(c == "", F.lit(0.0)).otherwise(-times(c) / F.length(value) * F.log2(times(c) / F.length(value)))
    times = lambda c: F.length(value) - F.length(F.replace(value, c, F.lit("")))
    described = values.select("value", letters.alias("letters")).select(
        "value", F.length(value).cast("double").alias("length"), (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1).cast("double").alias("transitions"),
        share("[^0-9]").alias("digit_share"), share("[^A-Z]").alias("upper_share"), share("[^0-9a-fA-F]").alias("hex_share"),
        (F.array_size(F.array_distinct(F.split(value, ""))) / F.length(value)).alias("distinct_share"), mean.alias("mean_bigram"),
        F.length(F.regexp_replace(value, "[^/]", "")).cast("double").alias("slashes"), F.length(F.regexp_replace(value, "[^.]", "")).cast("double").alias("dots"), value.contains("@").cast("double").alias("at_sign"),
        F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda a, c: a + part(c)).alias("entropy"))
    described = described.join(covered, "value", "left").withColumn("dictionary_share", F.coalesce("covered", F.lit(0)) / F.col("length")).drop("covered")
    letters_of = lambda c: F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))
    return found.join(described, "value").select(
        "*", F.col("quoted").cast("double").alias("__quoted"), (F.lower("left").rlike(KEY_STEMS) | F.col("left").rlike(USERINFO)).cast("double").alias("key_before"),
        (F.col("left").rlike(ASSIGNS) | F.col("left").rlike(KEYED)).cast("double").alias("assigned"),
        F.col("next").rlike(r"^[\"'`]?\s*[:=]").cast("double").alias("names_next"), letters_of(F.col("before")).alias("prev_letters"), letters_of(F.col("after")).alias("next_letters"),
        F.col("source").rlike(CONFIG_PATH).cast("double").alias("path_config"), F.col("source").rlike(SAMPLE_PATH).cast("double").alias("path_sample")).drop("quoted").withColumnRenamed("__quoted", "quoted")


def weak_label(found: DataFrame) -> Column:
    """A label for findings nobody labelled: 1 a secret, 0 none, null where nothing is known.

    1: the format of a known key, or a value that looks random and is no hash unless a key names it. 0: a harmless
    format (words, numbers, addresses, dates) that no key names, or a hash named as one.
    """
    value, named = F.col("value"), F.col("left").rlike(KEYED)
    random = (F.length(value) >= RANDOM_CHARS) & (F.col("entropy") >= RANDOM_BITS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"[.@]|/.*/") & ~value.rlike(HARMLESS)
    return (F.when(value.rlike(KNOWN_KEYS), 1.0).when(value.rlike(HARMLESS) & ~named, 0.0).when(value.rlike(HASHES) & F.col("left").rlike(HASH_NAMES), 0.0)
            .when(F.col("names_next") == 1, 0.0).when(random & (named | ~value.rlike(HASHES)), 1.0))


def seeds() -> list[tuple[int, str, str]]:
    """``(doc_id, text, secret)``: a fixed number of made texts, with the one secret in each, or with an empty one.

    Labels by construction, so that the forest knows forms the table has none of: every kind of value in every
    kind of place, and look-alikes in the same places under harmless names.
    """
    def raw(*of) -> bytes:
        return b"".join(hashlib.sha256(f"{of}{k}".encode()).digest() for k in range(2))

    def plain(i: int, n: int) -> str:
        return base64.b64encode(raw("plain", i)).decode().translate(str.maketrans("+/=", "xyz"))[:n]

    values = [
        lambda i: raw(i).hex()[:40], lambda i: raw(i).hex()[:32], lambda i: raw(i).hex()[:64], lambda i: plain(i, 20), lambda i: plain(i, 28), lambda i: base64.b64encode(raw(i)[:30]).decode(), lambda i: "ghp_" + plain(i, 36),
        lambda i: "AKIA" + base64.b32encode(raw(i)).decode()[:16], lambda i: "sk_live_" + plain(i, 24), lambda i: f"eyJhbGciOiJI.eyJ{plain(i, 30)}.{plain(i + 1, 40)}", lambda i: plain(i, 8), lambda i: plain(i, 12), lambda i: f"hunter{i % 97}", lambda i: "".join(chr(97 + b % 26) for b in raw(i)[:18]),
    ]
    places = ['say {k} = "{v}" end', '{k}="{v}"', "{k}={v}", "{k}: {v}", '{{"id":7,"{k}":"{v}","b":"text"}}', "{k}: '{v}'", "export {k}={v}", "run --{k} {v} now", "https://api.example.com/v1/list?{k}={v}&page=2", "<{k}>{v}</{k}>"]
    secret = ["token", "password", "API_KEY", "client_secret", "AWS_SECRET_ACCESS_KEY", "access_token", "db.passwd", "auth_token", "private_key", "PASSWORD"]
    harmless = ["commit", "sha256", "checksum", "etag", "revision", "request_id", "image", "build", "digest", "file"]
    innocent = [lambda i: raw(i).hex()[:40], lambda i: raw(i).hex()[:64], lambda i: raw(i).hex()[:32], lambda i: "some_longer_name_of_it", lambda i: f"src/main/module{i}/index.html", lambda i: f"2024-05-{i % 28 + 1:02d}T10:20:30", lambda i: f"{i}9415762804490123", lambda i: f"user.{i}@mail.example.com", lambda i: "configuration", lambda i: f"release-{i}.{i % 7}.0"]
    texts = [(place.format(k=secret[(i + j) % 10], v=value(97 * i + j)), value(97 * i + j)) for i, value in enumerate(values) for j, place in enumerate(places * 3)]
    texts += [(form.format(v=value(1000 + 97 * i + j)), value(1000 + 97 * i + j)) for i, value in enumerate(values[:10]) for j, form in enumerate(["Authorization: Bearer {v}", "curl -H 'Authorization: Bearer {v}' x"] * 8)]
    texts += [(f"https://user{i}:{plain(i, 9 + i % 9)}@db.example.com/main", plain(i, 9 + i % 9)) for i in range(40)]
    texts += [(f"alone {value(5000 + i + k)} there", value(5000 + i + k)) for k, value in enumerate(values[5:10]) for i in range(0, 80, 5)]
    texts += [(place.format(k=harmless[(i + j) % 10], v=value(7000 + 97 * i + j)), "") for i, value in enumerate(innocent) for j, place in enumerate(places * 5)]
    texts += [(f"an {value(9000 + 7 * i + k)} here", "") for i in range(12) for k, value in enumerate(innocent)]
    return [(i, text, value) for i, (text, value) in enumerate(texts)]


def train_forest(labelled: DataFrame, label_col: str, order_col: str, most: int = TRAIN_FINDINGS, seeded: DataFrame | None = None) -> RandomForestClassificationModel | None:
    """A forest of at most about ``most`` labelled findings of each label, taken by hashed ``order_col``; None without both labels.

    Both labels weigh the same, and so do the given findings and the ``seeded`` ones.
    """
    sizes = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect() if r[0] is not None}
    if len(sizes) < 2 and seeded is None:
        return None
    chance, weight = F.lit(0.0), F.lit(0.0)
    for label, n in sizes.items():
        chance = F.when(F.col(label_col) == label, min(1.0, most / n)).otherwise(chance)
        weight = F.when(F.col(label_col) == label, 1000.0 / min(n, most)).otherwise(weight)
    sample = labelled.where(F.pmod(F.xxhash64(order_col), F.lit(1_000_000)) < chance * 1_000_000).select(*FEATURES, F.col(label_col).alias("label"), weight.alias("weight"))
    if seeded is not None:
        made = {r[0]: r[1] for r in seeded.groupBy("label").count().collect()}
        share = F.when(F.col("label") == 1, 1000.0 / made.get(1.0, 1)).otherwise(1000.0 / made.get(0.0, 1))
        sample = sample.unionByName(seeded.select(*FEATURES, "label", share.alias("weight")))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", weightCol="weight").fit(ready.select("features", "label", "weight"))


def judged(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """``found`` with ``probability`` and ``is_secret``; without a model the weak label decides."""
    if model is None:
        return found.withColumn("probability", F.coalesce(weak_label(found), F.lit(0.0))).withColumn("is_secret", F.col("probability") > threshold)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    return scored.withColumn("probability", vector_to_array("probability")[1]).withColumn("is_secret", F.col("probability") > threshold).drop("features", "rawPrediction", "prediction")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``(doc_id, word_no, run_no, value, probability, is_secret)`` of every candidate in the whole texts.

    ``labelled`` holds findings as ``candidates`` returns them with a column ``label`` (1: secret). Without it
    the findings of the given rows whose crc32(doc_id) modulo 5 is not 0 are labelled by ``weak_label``, and
    those of ``seeds`` by construction. The
    forest and its bounded sample aside, everything covers all rows. A null or empty text has no findings, a
    null id is carried through, repeated rows repeat their findings, an empty table gives an empty result.
    """
    words = checkpointed(dictionary(docs, text_col))
    pairs = letter_transitions(words)
    found = checkpointed(with_features(checkpointed(candidates(docs, id_col, text_col)), words, pairs))
    if labelled is None:
        made = docs.sparkSession.createDataFrame(seeds(), "doc_id long, text string, secret string").coalesce(1)
        truth = candidates(made).join(made.select("doc_id", "secret"), "doc_id").withColumn("label", F.when((F.col("secret") != "") & F.expr("contains(secret, value)"), 1.0).otherwise(0.0))
        seeded = checkpointed(with_features(truth, words, pairs).select(*FEATURES, "label"))
        rows = found.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0).withColumn("label", weak_label(found))
    else:
        rows, seeded = with_features(labelled, words, pairs), None
    return judged(found, train_forest(rows, "label", "value", seeded=seeded)).select("doc_id", "word_no", "run_no", "value", "probability", "is_secret")


def redact(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every accepted value of a row's document replaced by ``mark``, the longest first;
    values under 12 characters only where no letter or digit adjoins them.

    Rows without an id, or without a finding, stay as they are; ``without_secrets`` gives every row a key first.
    A null or empty text stays, rows that share an id share their findings, an empty table gives an empty result.
    """
    values = findings.where("is_secret").groupBy("doc_id").agg(F.collect_set("value").alias("__values"))
    whole = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), v, F.lit(r"\E(?![A-Za-z0-9])"))
    without = lambda t, v: F.when(F.length(v) >= 12, F.replace(t, v, F.lit(mark))).otherwise(F.regexp_replace(t, whole(v), F.lit(mark)))
    longest_first = F.array_sort("__values", lambda a, b: F.length(b) - F.length(a))
    joined = docs.join(values.withColumnRenamed("doc_id", "__of"), F.col(id_col) == F.col("__of"), "left")
    text = F.when(F.col("__values").isNull(), F.col(text_col)).otherwise(F.aggregate(longest_first, F.col(text_col), without))
    return joined.withColumn(text_col, text).select(*docs.columns)


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets of every row replaced by ``mark``; rows without an id are scanned and redacted by their text.

    Nulls, empty texts, repeated rows and empty tables as in ``scan_secrets`` and ``redact``; no row is lost.
    """
    keyed = docs.withColumn("__row_key", row_key(id_col, text_col))
    return redact(keyed, scan_secrets(keyed, "__row_key", text_col), "__row_key", text_col, mark).select(*docs.columns)
