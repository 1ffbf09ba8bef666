"""Substring search by trigram postings (F1, F2, F6): a query reads the postings of its own trigrams.

``postings`` in a ``Store`` has a row per distinct trigram of a folded name and id, in parts by a hash of the trigram; the parts of
a trigram that very many names hold are written by several tasks. A query of three or more characters reads the parts of its trigrams, filtered on
them, keeps the ids that have them all, and verifies ``contains`` on the names of those alone. Shorter queries have
no trigram and scan the names (documented limit of the index, not of the result). Matching is literal, without wildcards,
and folds case as the scan does.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Commit, Store

GRAM = 3


def grams(text: Column) -> Column:
    """Distinct trigrams of a text (by code point)."""
    n = F.length(text)
    at = F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1)))
    return F.when(n >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(GRAM)))))


def query_grams(query: str) -> list[str]:
    q = query.lower()
    return sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})


class NameIndex:
    """Index of one text column by id below the tables ``postings`` and ``names`` of a store."""

    def __init__(self, store: Store, key: str, name: str, parts: int = 64, spread: int = 8):
        self.store, self.key, self.name, self.parts, self.spread = store, key, name, parts, spread

    def _part(self, gram: Column) -> Column:
        return F.lpad(F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("string"), len(str(self.parts - 1)), "0")

    def build(self, commit: Commit, rows: DataFrame) -> None:
        """Index all rows (null names have no posting); visible once the commit is published."""
        names = rows.select(*dict.fromkeys([self.key, self.name])).distinct()
        posted = names.select(F.explode(grams(F.lower(F.col(self.name)))).alias("gram"), F.col(self.key))
        commit.put("postings", posted, self._part(F.col("gram")), list(commit.tables.get("postings", {"parts": {}})["parts"]), self.spread)
        commit.put("names", names, F.lpad(F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("string"), len(str(self.parts - 1)), "0"),
                   list(commit.tables.get("names", {"parts": {}})["parts"]))

    def parts_of(self, query: str) -> list[str]:
        """The parts that hold the query's trigrams."""
        some = query_grams(query)
        if not some:
            return []
        one = self.store.spark.createDataFrame([(g,) for g in some], "gram string")
        return sorted({r[0] for r in one.select(self._part(F.col("gram"))).collect()})

    def candidates(self, query: str) -> DataFrame:
        """Ids whose names hold all trigrams of the query."""
        some = query_grams(query)
        hits = self.store.read("postings", self.parts_of(query)).where(F.col("gram").isin(some))
        return hits.groupBy(self.key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(some)).select(self.key)

    def search(self, query: str) -> DataFrame:
        """(key, name) of all names that contain the query, case folded."""
        names = self.store.read("names")
        if len(query) >= GRAM:
            names = names.join(self.candidates(query), self.key, "left_semi")
        return names.where(F.lower(F.col(self.name)).contains(query.lower()))


def search_brands(index: NameIndex, query: str, limit: int = 10) -> DataFrame:
    """As ``search.search_brands`` over an index whose key and name both are the brand."""
    return index.search(query).select(F.col(index.key).alias("brand")).distinct().orderBy("brand").limit(limit)


def suggest_products(index: NameIndex, query: str, limit: int = 5) -> DataFrame:
    return index.search(query).select("product_id", "product_name").orderBy("product_id").limit(limit)
