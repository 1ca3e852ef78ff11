"""Names of models, configurations and runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Keyword in a model name -> readable classifier name, first hit wins.
CLASSIFIER_NAMES = (
    ("logistic", "Logistic Reg."),
    ("xgboost", "XGBoost"),
    ("randomforest", "Random Forest"),
    ("multinomialnb", "Naive Bayes"),
    ("svm", "SVM"),
)

FEATURE_KEY_PATTERN = r"_([0-9a-f]{8}_tfidf(?:_grouped)?)"


def display_name(model: Column) -> Column:
    """Readable classifier and feature kind of a model name."""
    low = F.lower(model)
    first, *others = CLASSIFIER_NAMES
    kind = F.when(low.contains(first[0]), first[1])
    for key, name in others:
        kind = kind.when(low.contains(key), name)
    features = F.when(low.contains("tfidf"), "tf-idf").when(low.contains("perp"), "perplexities").otherwise("unknown")
    return F.when(kind.isNotNull(), F.concat(kind, F.lit(" "), features)).otherwise(F.substring(model, 1, 30))


def feature_key(model: Column) -> Column:
    """Configuration hash plus feature kind inside a model name, else null."""
    hit = F.regexp_extract(model, FEATURE_KEY_PATTERN, 1)
    return F.when(hit != "", hit)


def python_bool(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def config_text(max_features: Column, lo: Column, hi: Column, min_df: Column, max_df: Column, sublinear: Column) -> Column:
    """Canonical text of a TF-IDF configuration."""
    return F.concat(
        F.lit("max_features="), max_features.cast("string"),
        F.lit(",ngram_range=("), lo.cast("string"), F.lit(", "), hi.cast("string"),
        F.lit("),min_df="), min_df.cast("string"),
        F.lit(",max_df="), max_df.cast("string"),
        F.lit(",sublinear_tf="), python_bool(sublinear),
    )


def config_hash(text: Column) -> Column:
    """First eight hex digits of the SHA-256 of a configuration text."""
    return F.substring(F.sha2(text, 256), 1, 8)


def readable_config(max_features: Column, lo: Column, hi: Column) -> Column:
    return F.concat(F.lit("tfidf_"), max_features.cast("string"), F.lit("_ngram"), lo.cast("string"), F.lit("-"), hi.cast("string"))
