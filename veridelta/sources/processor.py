"""Documents under a fixed context: expansion of terms, compaction, flattening, and statements, after a check of size and depth. Remote contexts are not fetched."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veridelta.functions import transport as T
from veridelta.sources.rdf import spread

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@dataclass(frozen=True)
class Processor:
    """context: term -> IRI, or a definition with @id; prefixes are terms too."""

    context: dict = field(default_factory=dict)
    max_chars: int = 10 << 20
    max_depth: int = 100

    def iri(self, term: str) -> str:
        if term.startswith("@"):
            return term
        if term in self.context:
            x = self.context[term]
            to = x.get("@id", term) if isinstance(x, dict) else x
            return self.iri(to) if to != term else term
        head, colon, rest = term.partition(":")
        return self.iri(head) + rest if colon and head in self.context and not rest.startswith("//") else self.context.get("@vocab", "") + term if not colon and "@vocab" in self.context else term

    def _expand(self, x: object) -> object:
        if isinstance(x, list):
            return [z for v in x for y in (self._expand(v),) for z in (y if isinstance(y, list) else [y])]
        if not isinstance(x, dict):
            return {"@value": x}
        if "@value" in x:
            return dict(x)
        out: dict = {}
        for k, v in x.items():
            if k == "@context":
                continue
            if k in ("@id", "@type"):
                out[k] = [self.iri(t) for t in (v if isinstance(v, list) else [v])] if k == "@type" else self.iri(v)
            elif k.startswith("@"):
                out[k] = self._expand(v) if k == "@graph" else v
            elif v is not None and ":" in self.iri(k):  # null, and terms that stand for no IRI, are dropped
                kind = self.context.get(k, {}).get("@type") if isinstance(self.context.get(k), dict) else None
                y = self._expand(v)
                y = y if isinstance(y, list) else [y]
                out[self.iri(k)] = [{"@id": self.iri(z["@value"])} if kind == "@id" and isinstance(z.get("@value"), str) else z for z in y]
        return out

    def _compact(self, x: object) -> object:
        names = {self.iri(t): t for t in self.context if not t.startswith("@")}
        if isinstance(x, list):
            y = [self._compact(v) for v in x]
            return y[0] if len(y) == 1 else y
        if not isinstance(x, dict):
            return x
        if set(x) == {"@value"}:
            return x["@value"]
        out = {}
        for k, v in x.items():
            if k == "@type":
                t = [names.get(i, i) for i in v]
                out[k] = t[0] if len(t) == 1 else t
            else:
                out[names.get(k, k)] = v if k.startswith("@") and k != "@graph" else self._compact(v)
        return out

    def _flatten(self, x: object) -> list[dict]:
        nodes: dict[str, dict] = {}
        fresh = iter(range(1 << 62))

        def walk(v: object) -> object:
            if not isinstance(v, dict) or "@value" in v:
                return v
            if set(v) == {"@graph"}:
                for y in v["@graph"]:
                    walk(y)
                return None
            name = v.get("@id") or f"_:b{next(fresh)}"
            node = nodes.setdefault(name, {"@id": name})
            for k, w in v.items():
                if k == "@id":
                    continue
                if not isinstance(w, list):
                    node[k] = w
                    continue
                have = node.setdefault(k, [])
                for y in w:
                    z = walk(y)
                    if z not in have:
                        have.append(z)
            return {"@id": name}

        for y in self._expand(x) if isinstance(x, list) else [self._expand(x)]:
            walk(y)
        return [n for _, n in sorted(nodes.items()) if len(n) > 1]

    def _mapped(self, document: Column, f: object) -> Column:
        @F.pandas_udf(StringType())
        def run(text: pd.Series) -> pd.Series:
            return text.map(lambda t: None if t is None else json.dumps(f(json.loads(t))))

        ok = T.within_limits(document, self.max_chars, self.max_depth)
        return run(F.when(ok, document).when(document.isNotNull(), F.raise_error(F.lit("document beyond the limits of size or depth")).cast("string")))

    def expand(self, document: Column) -> Column:
        return self._mapped(document, lambda x: [z for y in (self._expand(x),) for z in (y if isinstance(y, list) else [y]) if z])

    def compact(self, document: Column) -> Column:
        return self._mapped(document, lambda x: {"@context": self.context} | (c if isinstance(c := self._compact(self._expand(x)), dict) else {"@graph": c}))

    def flatten(self, document: Column) -> Column:
        return self._mapped(document, self._flatten)

    def statements(self, df: DataFrame, document: str) -> DataFrame:
        """(subject, predicate, object, kind): a row for each value of the flattened documents; kind is iri or literal."""
        v = spread(df.select(document), document).select(F.explode(F.from_json(self.flatten(F.col(document)), "array<map<string,variant>>")).alias("n"))
        rows = v.select(F.try_variant_get(F.col("n")["@id"], "$", "string").alias("subject"), F.explode("n").alias("p", "x")).where("p <> '@id'")
        each = rows.select("subject", "p", F.explode(F.try_variant_get("x", "$", "array<variant>")).alias("o"))
        node = F.try_variant_get("o", '$["@id"]', "string")
        value = F.when(F.col("p") == "@type", F.try_variant_get("o", "$", "string")).otherwise(F.coalesce(node, F.try_variant_get("o", '$["@value"]', "string")))
        return each.select("subject", F.when(F.col("p") == "@type", TYPE).otherwise(F.col("p")).alias("predicate"), value.alias("object"), F.when((F.col("p") == "@type") | node.isNotNull(), "iri").otherwise("literal").alias("kind")).where("object IS NOT NULL").distinct()

    def documents(self, statements: DataFrame) -> DataFrame:
        """(subject, json): an expanded node for each subject of statements(subject, predicate, object, kind)."""
        value = F.when(F.col("kind") == "iri", F.to_json(F.struct(F.col("object").alias("@id")))).otherwise(F.to_json(F.struct(F.col("object").alias("@value"))))
        value = F.when(F.col("predicate") == TYPE, F.to_json(F.array("object"))).otherwise(value)
        per = statements.groupBy("subject", "predicate").agg(F.sort_array(F.collect_list(value)).alias("v"))
        text = F.when(F.col("predicate") == TYPE, F.concat(F.lit('"@type":['), F.array_join(F.transform("v", lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), ","), F.lit("]"))).otherwise(F.concat(F.lit('"'), "predicate", F.lit('":['), F.array_join("v", ","), F.lit("]")))
        return per.groupBy("subject").agg(F.sort_array(F.collect_list(text)).alias("t")).select("subject", F.concat(F.lit('{"@id":"'), "subject", F.lit('",'), F.array_join("t", ","), F.lit("}")).alias("json"))

