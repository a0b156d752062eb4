"""Named evaluation datasets, from families and their language lists.

A dataset is stored as parquet under ``root/<path>/<name>/<split>`` with ``/`` and
``.`` of the names kept.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from procspark.operators.tags import NER_TAGS, remap_tags

# Languages of each dataset family.
XNLI = "en es de fr el bg ru tr ar vi th zh hi sw ur".split()
AMNLI = "aym bzd cni gn hch nah oto quy shp tar".split()
INDICXNLI = "as bn gu hi kn ml mr or pa ta te".split()
PAWSX = "en de es fr ja ko zh".split()
WIKIANN = "en ar de ru zh ja ur ay qu ta sw yo rw am ig hi fr es vi tr bg te el he fi hu".split()
MASAKHANER = "amh hau ibo kin lug luo pcm swa wol yor".split()
MASAKHANER2 = "bam bbj ewe fon hau ibo kin lug mos nya pcm sna swa tsn twi wol xho yor zul".split()
UDPOS = ("Afrikaans Arabic Basque Bulgarian Dutch English Estonian Finnish French German Greek Hebrew Hindi "
         "Hungarian Indonesian Italian Japanese Korean Chinese Marathi Persian Portuguese Russian Spanish Tamil "
         "Telugu Turkish Urdu Vietnamese").split()
UDPOS_TEST_ONLY = "Kazakh Tagalog Thai Yoruba".split()
TYDIQA = "ar bn fi id ko ru sw te".split()
MLQA = "en ar de es hi vi zh".split()
XCOPA = "et ht id it qu sw ta th tr vi zh".split()

# Family -> (task, source path, name pattern, languages).
FAMILIES = {
    "xnli": ("nli", "xnli", "{lang}", XNLI),
    "amnli": ("nli", "americas_nli", "{lang}", AMNLI),
    "indicxnli": ("nli", "Divyanshu/indicxnli", "{lang}", INDICXNLI),
    "pawsx": ("pawsx", "paws-x", "{lang}", PAWSX),
    "wikiann": ("ner", "wikiann", "{lang}", WIKIANN),
    "masakhaner": ("ner", "masakhaner", "{lang}", MASAKHANER),
    "masakhaner2": ("ner", "masakhane/masakhaner2", "{lang}", MASAKHANER2),
    "udpos": ("pos", "xtreme", "udpos.{lang}", UDPOS),
    "mlqa": ("qa", "mlqa", "mlqa.{lang}.{lang}", MLQA),
    "xcopa": ("choice", "xcopa", "{lang}", XCOPA),
}
# Training sets, (task, path, name); the name may hold a language.
TRAIN = {
    "mnli": ("nli", "glue", "mnli", None), "pawsx": ("pawsx", "paws-x", "{lang}", "en"),
    "wikiann": ("ner", "wikiann", "{lang}", "en"), "udpos": ("pos", "xtreme", "udpos.{lang}", "English"),
    "squad": ("qa", "squad", "", None), "tydiqa_goldp": ("qa", "tydiqa_goldp", "en", None),
    "copa": ("choice", "super_glue", "copa", None), "siqa": ("choice", "social_i_qa", "", None),
}
# Per task, logical name -> column.
COLUMNS = {
    "nli": {"text": "premise", "text_pair": "hypothesis", "label": "label"},
    "pawsx": {"text": "sentence1", "text_pair": "sentence2", "label": "label"},
    "ner": {"text": "tokens", "label": "ner_tags"},
    "pos": {"text": "tokens", "label": "pos_tags"},
    "qa": {"question": "question", "context": "context", "answers": "answers"},
    "choice": {"context": "premise", "question": "question", "label": "label"},
}
CSV_FORMAT = "csv"


@dataclass(frozen=True)
class Entry:
    dataset_name: str
    role: str          # train, validation or test
    task: str
    path: str
    name: str
    split: str         # physical split that is read
    lang: str | None = None
    data_files: str | None = None


def _family(key: str) -> list[Entry]:
    task, path, pattern, langs = FAMILIES[key]
    extra = UDPOS_TEST_ONLY if key == "udpos" else []
    return [Entry(f"{role}_{key}_{lang}", role, task, path, pattern.format(lang=lang), role, lang)
            for role, names in (("validation", langs), ("test", langs + extra)) for lang in names]


def _tydiqa() -> list[Entry]:
    """English is only tested; the other languages validate on their train split."""
    roles = [("test", "dev", ["en"] + TYDIQA), ("validation", "train", TYDIQA)]
    return [Entry(f"{role}_tydiqa_{lang}", role, "qa", "tydiqa_goldp", lang, split, lang)
            for role, split, langs in roles for lang in langs]


def _copa() -> list[Entry]:
    return [Entry("validation_copa_en", "validation", "choice", "super_glue", "copa", "validation", "en"),
            Entry("test_copa_en", "test", "choice", CSV_FORMAT, "", "train", "en", "copa/en_test.csv")]


def evaluation_entries(families: Iterable[str] | None = None) -> list[Entry]:
    """All validation and test datasets, or those of some families."""
    wanted = set(families or [*FAMILIES, "tydiqa", "copa"])
    out = [e for f in FAMILIES if f in wanted for e in _family(f)]
    out += _tydiqa() if "tydiqa" in wanted else []
    return out + (_copa() if "copa" in wanted else [])


def train_entry(name: str, lang: str | None = None) -> Entry:
    """A training dataset; ``lang`` falls back to the family's default."""
    task, path, pattern, default = TRAIN[name]
    lang = (lang or default) if default else None
    return Entry(name, "train", task, path, pattern.format(lang=lang), "train", lang)


def catalogue(spark: SparkSession, entries: Iterable[Entry] | None = None) -> DataFrame:
    rows = [(e.dataset_name, e.role, e.task, e.path, e.name, e.split, e.lang, e.data_files)
            for e in (entries or evaluation_entries())]
    return spark.createDataFrame(rows, "dataset_name string, role string, task string, path string, "
                                       "name string, split string, lang string, data_files string")


def location(root: str, e: Entry) -> str:
    return os.path.join(root, e.data_files) if e.data_files else os.path.join(root, e.path, e.name, e.split)


def read_entry(spark: SparkSession, root: str, e: Entry, schema: str | None = None) -> DataFrame:
    """Rows of one dataset with ``dataset_name``, ``lang`` and ``split`` (its role)."""
    return read_entries(spark, root, [e], schema)


def _place(e: Entry) -> str:
    return location("", e).rstrip("/")


def read_entries(spark: SparkSession, root: str, entries: Iterable[Entry], schema: str | None = None) -> DataFrame:
    """Rows of all datasets with ``dataset_name``, ``lang`` and ``split`` (its role); columns a dataset lacks are null.

    One scan for each source path (``Entry.path``), which all its datasets share a schema in, so the plan does not
    grow with the number of datasets. A row's file tells its place, which is joined with the entries; a place that
    several entries name gives its rows to each.
    """
    by_path: dict[tuple[str, bool], list[Entry]] = {}
    for e in entries:
        by_path.setdefault((e.path, e.data_files is not None), []).append(e)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [_read_path(spark, root, some, schema) for some in by_path.values()])


def _read_path(spark: SparkSession, root: str, entries: list[Entry], schema: str | None) -> DataFrame:
    paths = sorted({location(root, e) for e in entries})
    reader = spark.read.schema(schema) if schema else spark.read
    if entries[0].data_files:
        df = reader.options(header=True, multiLine=True, escape='"').csv(paths)
    else:
        df = reader.parquet(*paths)
    if entries[0].path.endswith(("masakhaner", "masakhaner2")):
        df = df.withColumn("ner_tags", remap_tags(F.col("ner_tags"), len(NER_TAGS)))
    bare = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/")))
    places = "|".join(re.escape(p) for p in sorted({_place(e) for e in entries}, key=len, reverse=True))
    names = spark.createDataFrame([(_place(e), e.dataset_name, e.lang, e.role) for e in entries],
                                  "_place string, dataset_name string, lang string, split string")
    own = [c for c in df.columns if c not in ("dataset_name", "lang", "split")]
    found = df.select(*own, F.regexp_extract("_metadata.file_path", f"^.*?{bare}/({places})(?:/[^/]*)?$", 1).alias("_place"))
    return found.join(names, "_place").select(*own, "dataset_name", "lang", "split")


def to_logical(df: DataFrame, column_names: dict[str, str]) -> DataFrame:
    """Rename physical columns to the logical names used by the operators."""
    return df.withColumnsRenamed({v: k for k, v in column_names.items()})
