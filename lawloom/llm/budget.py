"""Token budget per source, language and domain (problem 2).

The tokens of every chunk under a public tokenizer are predicted by a regression per language on bytes, words,
digits, punctuation and characters by script, and the predictions are corrected by the bias measured on
tokenized holdouts. Only the fitting and holdout rows are tokenized: their share is set so that about
`SAMPLE_ROWS` rows are (the documented bound of the sample); the regression is applied to every row. What is
gathered from the sample are sums of products of features, added up where the rows are; the driver solves one
small system per language.

Defined results: a null text has null features and null tokens; an empty text has 0 tokens; a null language is
told from the script ('vi' for Vietnamese letters, 'und' where undecided); a language that the sample lacks is
predicted by the model of all languages; a law that cannot be matched has source and domain 'unknown'; repeated
keys are estimated independently; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import MAX_BROADCAST_ROWS, table
from .tokens import DEFAULT_VOCAB, count_tokens, vocab_path

#: Bound of the tokenized sample, in rows; one in HOLDOUT of them is held out to measure the bias.
SAMPLE_ROWS, HOLDOUT = 6_000, 4
#: The project's own estimate: characters divided by this, fraction dropped.
CHARS_PER_TOKEN = 3.5

FEATURES = ("bytes", "chars", "words", "digits", "punctuation", "upper", "latin", "marked_latin", "cyrillic", "arabic", "devanagari", "thai", "khmer", "kana", "han", "other")
_FIELDS = ", ".join(f"{f} bigint" for f in FEATURES)

#: First code point, last code point, feature: characters by script (fixed values of the Unicode blocks).
_RANGES = (
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC0, 0x24F, "marked_latin"), (0x300, 0x36F, "marked_latin"), (0x1E00, 0x1EFF, "marked_latin"),
    (0x400, 0x52F, "cyrillic"), (0x600, 0x6FF, "arabic"), (0x750, 0x77F, "arabic"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFF, "arabic"),
    (0x900, 0x97F, "devanagari"), (0xE00, 0xE7F, "thai"), (0x1780, 0x17FF, "khmer"), (0x19E0, 0x19FF, "khmer"), (0x3041, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xF900, 0xFAFF, "han"),
)
_SCRIPTS = tuple(dict.fromkeys(f for *_, f in _RANGES)) + ("other",)
_SPACE, _DIGIT, _PUNCT = 20, 21, 22


def _classes() -> np.ndarray:
    """A class for each code point of the basic plane."""
    out = np.full(0x10000, _SCRIPTS.index("other"), np.uint8)
    for lo, hi, name in _RANGES:
        out[lo : hi + 1] = _SCRIPTS.index(name)
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = _SPACE
    out[0x30:0x3A] = _DIGIT
    for lo, hi in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xA1, 0xBF), (0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3030), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20)):
        out[lo : hi + 1] = _PUNCT
    return out


_CLASS = _classes()


def text_features(text: str) -> tuple[int, ...]:
    """The features of one text, counted over all its characters."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _CLASS[np.where(raw < 0x10000, raw, 0xFFFF)]
    n = np.bincount(kinds, minlength=24)
    solid = kinds != _SPACE
    words = int(solid[:1].sum() + (solid[1:] & ~solid[:-1]).sum())
    upper = int(((raw >= 0x41) & (raw <= 0x5A)).sum())
    size = int(len(raw) + (raw > 0x7F).sum() + (raw > 0x7FF).sum() + (raw > 0xFFFF).sum())
    return (size, len(raw), words, int(n[_DIGIT]), int(n[_PUNCT]), upper, *(int(n[i]) for i in range(len(_SCRIPTS))))


def with_features(df: DataFrame, text_col: str) -> DataFrame:
    """The rows with a struct `f` of features of the text (null for a null text)."""

    @F.pandas_udf(f"struct<{', '.join(f'{f}:bigint' for f in FEATURES)}>")
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_features(t) if t is not None else (None,) * len(FEATURES) for t in texts], columns=list(FEATURES)).astype("Int64")

    return df.withColumn("f", count(F.col(text_col)))


def language(lang: Column) -> Column:
    """The recorded language, or what the script tells of it."""
    f = lambda name: F.col(f"f.{name}")
    letters = sum((f(s) for s in _SCRIPTS[1:]), f(_SCRIPTS[0]))
    most = lambda name: f(name) * 2 > letters
    told = (
        F.when(f("kana") * 10 > letters, "ja").when(most("han"), "zh").when(most("thai"), "th").when(most("khmer"), "km").when(most("devanagari"), "hi")
        .when(most("arabic"), "ar").when(most("cyrillic"), "ru").when(f("marked_latin") * 8 > letters, "vi").otherwise("und")
    )
    return F.coalesce(F.nullif(F.lower(F.trim(lang)), F.lit("")), told)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), rows[list(FEATURES)].to_numpy(float) / 100.0])


def fit_models(featured: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS) -> dict[str, list[tuple[np.ndarray, float, float, int]]]:
    """Per language, for the public tokenizer in `path` and for the project's own estimate: the coefficients with
    the bias factor applied, that factor, the relative error of the corrected total of rows used for neither, and the rows used.
    The model of all languages stands under '*'.
    """
    total = featured.where("t is not null").count()
    share = min(1.0, sample_rows / max(1, total))
    width = len(FEATURES) + 1
    within = int(share * 1_000_000)
    drawn = F.pmod(F.xxhash64("k", F.lit(29)), F.lit(1_000_000))
    sampled = featured.where("t is not null").withColumn("h", drawn).where(F.col("h") < within).select("lang", "t", "h", *(F.col(f"f.{f}").alias(f) for f in FEATURES))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            y = np.array([(count_tokens(t, path), int(len(t) / CHARS_PER_TOKEN)) for t in batch["t"]], float).reshape(-1, 2)
            x = _matrix(batch)
            turn = batch["h"].to_numpy() % HOLDOUT
            held = np.where(turn == 0, 1, np.where(turn == 1, 2, 0))  # 0 to fit, 1 to correct the bias, 2 to measure
            for lang in batch["lang"].unique():
                for part in (0, 1, 2):
                    rows = (batch["lang"].to_numpy() == lang) & (held == part)
                    if rows.any():
                        a, b = x[rows], y[rows]
                        # rows weigh by the inverse of their length, so that short ones count too
                        w = 1.0 / np.maximum(0.01, a[:, 2:3])
                        new = [(a * w).T @ a, (a * w).T @ b, a.sum(0), b.sum(0), len(b)]
                        old = sums.get((lang, part))
                        sums[lang, part] = new if old is None else [p + q for p, q in zip(old, new)]
        rows = [(lang, part, xx.ravel().tolist(), xy.ravel().tolist(), sx.tolist(), sy.tolist(), int(n)) for (lang, part), (xx, xy, sx, sy, n) in sums.items()]
        yield pd.DataFrame(rows, columns=["lang", "part", "xx", "xy", "sx", "sy", "n"])

    pieces = sampled.mapInPandas(gather, "lang string, part int, xx array<double>, xy array<double>, sx array<double>, sy array<double>, n bigint")

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sums = {c: np.sum(np.stack(rows[c].tolist()), axis=0).tolist() for c in ("xx", "xy", "sx", "sy")}
        return pd.DataFrame([{"lang": key[0], "part": key[1], **sums, "n": int(rows["n"].sum())}])

    groups: dict[tuple[str, int], list] = {}
    # one row of a few hundred numbers per language and part, added up in tasks
    for r in pieces.groupBy("lang", "part").applyInPandas(add, pieces.schema).collect():
        new = [np.array(r["xx"]).reshape(width, width), np.array(r["xy"]).reshape(width, 2), np.array(r["sx"]), np.array(r["sy"]), r["n"]]
        for key in ((r["lang"], r["part"]), ("*", r["part"])):
            groups[key] = [a + b for a, b in zip(groups[key], new)] if key in groups else new
    models: dict[str, list] = {}
    for lang in {k for k, _ in groups}:
        fit = groups.get((lang, 0)) or groups.get((lang, 1)) or groups[lang, 2]
        held = groups.get((lang, 1)) or fit
        test = groups.get((lang, 2)) or held
        coef = np.linalg.solve(fit[0] + 1e-9 * np.trace(fit[0]) * np.eye(width), fit[1])
        models[lang] = []
        for i in (0, 1):
            predicted, actual = float(held[2] @ coef[:, i]), float(held[3][i])
            bias = actual / predicted if predicted > 0 and actual > 0 else 1.0
            told, true = float(test[2] @ coef[:, i]) * bias, float(test[3][i])
            models[lang].append((coef[:, i] * bias, bias, abs(true - told) / true if true else 0.0, int(fit[4] + held[4])))
    return models


def _predicted(coef: str) -> Column:
    """The sum of coefficients times features, at least 1 for a text that has characters."""
    values = F.array(F.lit(1.0), *[F.col(f"f.{name}") / F.lit(100.0) for name in FEATURES])
    dot = F.aggregate(F.zip_with(F.col(coef), values, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.col("f.chars") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), dot))


def token_estimates(chunks: DataFrame, id_col: str = "chunk_key", text_col: str = "text", vocab: str = DEFAULT_VOCAB, folder: str | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per chunk: language, tokens predicted under the public tokenizer, and the check of its recorded count.

    `project_fit` is the regression's prediction of the project's own estimate, `project_tokens` that estimate
    itself; `recorded` is 'missing', 'far' (off by more than the regression leaves room for), 'off' or 'true'.
    """
    has = set(chunks.columns)
    opt = lambda name, kind: (F.col(name) if name in has else F.lit(None)).cast(kind).alias(name)
    base = chunks.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t"), opt("lang", "string"), opt("token_count", "int"), opt("source_law_id", "string"), opt("document_name", "string"))
    featured = with_features(base, "t").withColumn("lang", language(F.col("lang")))
    models = fit_models(featured, vocab_path(vocab, folder), sample_rows)
    spark = chunks.sparkSession
    # one row per language of the bounded sample
    by_lang = spark.createDataFrame([(name, m[0][0].tolist(), m[1][0].tolist()) for name, m in sorted(models.items())], "lang string, c0 array<double>, c1 array<double>")
    shared = models.get("*")
    default = [F.array(*[F.lit(float(v)) for v in shared[i][0]]) if shared else F.lit(None).cast("array<double>") for i in (0, 1)]
    fitted = (
        featured.join(F.broadcast(by_lang), "lang", "left")
        .withColumn("c0", F.coalesce("c0", default[0]))
        .withColumn("c1", F.coalesce("c1", default[1]))
        .select(
            F.col("k").alias("chunk_key"), "lang", "source_law_id", "document_name", "token_count",
            _predicted("c0").alias("tokens"), _predicted("c1").alias("project_fit"),
            F.floor(F.col("f.chars") / F.lit(CHARS_PER_TOKEN)).cast("int").alias("project_tokens"),
        )
    )
    room = F.greatest(F.lit(5.0), F.col("project_fit") * 0.05)
    gap = F.abs(F.col("token_count") - F.col("project_fit"))
    exact = F.col("token_count") == F.col("project_tokens")
    return fitted.select(
        "chunk_key", "lang", "source_law_id", "document_name", "token_count", F.round("tokens").cast("bigint").alias("tokens"), "project_fit", "project_tokens",
        F.when(F.col("token_count").isNull(), "missing").when((gap > room) & ~exact, "far").when(~exact, "off").when(exact, "true").alias("recorded"),
    )


def _law_key(c: Column) -> Column:
    """A law id without letter case, blanks and separators."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _name_key(c: Column) -> Column:
    """A document name without letter case, file ending, remarks in brackets, blanks and separators."""
    bare = F.regexp_replace(F.lower(c), r"\([^)]*\)|\[[^\]]*\]|\.(txt|docx?|pdf|html?)\s*$", " ")
    return F.regexp_replace(bare, r"[^\p{L}\p{M}\p{N}]+", "")


def match_laws(rows: DataFrame, laws: DataFrame) -> DataFrame:
    """The rows with `law_id`, `source` and `domain` of their law: by id first, by document name where that fails.

    The registry is copied to every task only if it is small; a name shared by several laws is not matched.
    """
    ids = laws.select(_law_key(F.col("law_id")).alias("ik"), F.col("law_id").alias("l1"), F.col("source").alias("s1"), F.col("legal_domain").alias("d1")).dropDuplicates(["ik"])
    names = (
        laws.groupBy(_name_key(F.col("law_name")).alias("nk"))
        .agg(F.count("*").alias("n"), F.first("law_id").alias("l2"), F.first("source").alias("s2"), F.first("legal_domain").alias("d2"))
        .where("n = 1").drop("n")
    )
    if laws.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        ids, names = F.broadcast(ids), F.broadcast(names)
    keyed = rows.withColumn("ik", _law_key(F.col("source_law_id"))).withColumn("nk", _name_key(F.col("document_name")))
    joined = keyed.join(ids, "ik", "left").join(names, "nk", "left")
    by_id = F.col("l1").isNotNull()
    pick = lambda a, b: F.when(by_id, F.col(a)).otherwise(F.col(b))
    return joined.select(*rows.columns, pick("l1", "l2").alias("law_id"), F.coalesce(pick("s1", "s2"), F.lit("unknown")).alias("source"), F.coalesce(pick("d1", "d2"), F.lit("unknown")).alias("domain"))


def token_budget(estimates: DataFrame, laws: DataFrame) -> DataFrame:
    """Tokens by source, language and domain, with totals over each of them and over all."""
    rows = match_laws(estimates, laws)
    return rows.groupingSets([("source", "lang", "domain"), ("source",), ("lang",), ("domain",), ()], "source", "lang", "domain").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("chunks"),
        F.sum("tokens").alias("tokens"),
        F.sum("project_tokens").alias("project_tokens"),
        F.count_if(F.col("recorded") != "true").alias("wrong_counts"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_estimates(table(spark, sf_dir, "chunks")).where("recorded <> 'true'").select("chunk_key")


def p2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every chunk and the law it belongs to."""
    rows = match_laws(token_estimates(table(spark, sf_dir, "chunks")), table(spark, sf_dir, "laws"))
    return rows.select("chunk_key", "lang", "law_id", "source", "domain", "tokens", "project_tokens", "recorded")


def p2_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted models: rows tokenized, bias factor and relative error of the total of rows used for neither, by language."""
    chunks = table(spark, sf_dir, "chunks").select(F.col("chunk_key").alias("k"), F.col("text").alias("t"), "lang")
    models = fit_models(with_features(chunks, "t").withColumn("lang", language(F.col("lang"))), vocab_path())
    rows = [(lang, m[0][3], float(m[0][1]), float(m[0][2])) for lang, m in models.items()]
    return spark.createDataFrame(rows, "lang string, rows_tokenized bigint, bias double, holdout_error double")


def p2_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(token_estimates(table(spark, sf_dir, "chunks")), table(spark, sf_dir, "laws"))


QUERIES = {"p2_found": p2_found, "p2_tokens": p2_tokens, "p2_budget": p2_budget, "p2_models": p2_models}
ORACLE_SQL = {"p2_found": "SELECT chunk_key FROM chunks WHERE token_count IS NULL OR token_count <> floor(length(text) / 3.5)"}
