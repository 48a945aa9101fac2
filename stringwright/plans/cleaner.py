"""The whole job: learn on one table, apply to that table or to others like it."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringwright import constants as K
from stringwright.operators import encode as E
from stringwright.operators import features as P
from stringwright.operators import missing as M
from stringwright.operators import ordinality as L
from stringwright.operators import outliers as O
from stringwright.operators import report as R
from stringwright.operators import types as T
from stringwright.operators import values as V
from stringwright.session import settle

NUMBERS = ("long", "integer", "double", "float", "short", "byte")


class StringCleaner:
    """Settings of a cleaning job; ``fit`` learns, the returned model transforms.

    target           name of the label column; it is kept, coded if it is text
    encode           turn the cleaned columns into numbers
    dense            keep vectors in one array column instead of one column per dimension
    nouns            table ``<word>`` for sentence columns
    gazetteer        table ``<zip, city, country, lat, lon>`` for coordinates and postal codes
    valence          table ``<word, polarity, intensity>`` that orders ordinal categories
    orders           explicit category orders per column
    word_vectors     table ``<word, vec>`` for the ordinality features
    ordinality_model fitted classifier; without one a rule on names and words decides
    plain_strings    also repair misspellings in anomaly-free plain text columns
    strict_numbers   a later text that is no number in a column learnt as numbers ends the job; off, it
                     becomes null
    compat_ngrams    leave out the last two 3-grams of every value
    compat_xyz       take coordinates as radians
    """

    def __init__(
        self,
        target: str | None = None,
        encode: bool = True,
        dense: bool = True,
        nouns: DataFrame | None = None,
        gazetteer: DataFrame | None = None,
        cell_degrees: float = 1.0,
        radius_km: float = 100.0,
        valence: DataFrame | None = None,
        orders: dict[str, list[str]] | None = None,
        word_vectors: DataFrame | None = None,
        vector_dims: int = K.EMBEDDING_DIMS,
        ordinality_model: PipelineModel | None = None,
        plain_strings: bool = False,
        strict_numbers: bool = True,
        compat_ngrams: bool = False,
        compat_xyz: bool = False,
        seed: int = 0,
        types: T.TypeRegistry = T.DEFAULT_TYPES,
    ) -> None:
        self.target = target
        self.encode = encode
        self.dense = dense
        self.valence = valence
        self.orders = orders or {}
        self.word_vectors = word_vectors
        self.vector_dims = vector_dims
        self.ordinality_model = ordinality_model
        self.plain_strings = plain_strings
        self.strict_numbers = strict_numbers
        self.drop_last = 2 if compat_ngrams else 0
        self.seed = seed
        self.registry = types
        self.options = {
            "nouns": nouns,
            "gazetteer": gazetteer,
            "cell_degrees": cell_degrees,
            "radius_km": radius_km,
            "in_degrees": not compat_xyz,
            "registry": types,
        }

    def fit(self, df: DataFrame) -> StringCleanerModel:
        model = StringCleanerModel(self)
        table = M.nan_to_null(V.normalise_spaces(df))
        model.empty = [c for c in V.empty_columns(table) if c != self.target]
        # written once: every later step reads the normalised table, not the source, which may be one
        # small file or few tasks that adaptive execution has merged
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        table = settle(table.drop(*model.empty).repartition(parts))
        self._fit_target(model, table)
        body = [c for c in table.columns if c != self.target]
        inputs = table.select(*body)

        model.types = T.infer_table(inputs, self.registry)
        labelled = settle(self._labelled(inputs, model.types))
        model.found = labelled
        model.first_types = dict(model.types)
        for row in T.missing_tokens(labelled).collect():
            model.tokens.setdefault(row["col"], []).append(row["value"])
        model.missing = M.plan_missing(M.tokens_to_null(inputs, model.tokens), model.types, body)
        model.inputs = inputs

        complete = model.missing.transform(M.tokens_to_null(table, model.tokens))
        if model.missing.strategy == "regression":
            complete = settle(complete)
        if model.missing.strategy != "none":
            labelled = settle(self._labelled(complete.select(*body), model.types))
        self._fit_repairs(model, labelled)
        repaired = model._repair(complete)
        self._fit_features(model, repaired)
        if self.encode:
            self._fit_encoders(model, model._process(repaired))
        return model

    def _fit_target(self, model: StringCleanerModel, table: DataFrame) -> None:
        if self.target is None:
            return
        model.balanced = bool(E.class_balance(table, self.target).first()["balanced"])
        if self.encode and table.schema[self.target].dataType.typeName() not in NUMBERS:
            model.target_codes = settle(V.sorted_codes(table, self.target))

    def _labelled(self, inputs: DataFrame, types: dict[str, str]) -> DataFrame:
        """``<col, value, n, type, label>`` of the text columns. Of sentence columns only
        texts that are not normal are listed: nothing looks at their other values."""
        spark = inputs.sparkSession
        text = V.string_columns(inputs)
        schema = spark.createDataFrame([(c, types[c]) for c in text] or [("", "")], "col string, type string")
        long_cols = [c for c in text if types[c] == "sentence"]
        short = [c for c in text if c not in long_cols]
        parts = []
        if short:
            parts.append(T.label_values(V.value_table(inputs, short), schema, self.registry))
        if long_cols:
            rows = V.long_form(inputs, long_cols).where(F.col("value").isNotNull())
            odd = rows.where(T.value_label(F.col("value"), F.lit("sentence"), self.registry) != "normal")
            counted = odd.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
            parts.append(T.label_values(counted, schema, self.registry))
        if not parts:
            return spark.createDataFrame([], "col string, value string, n bigint, type string, label string")
        fields = ["col", "value", "n", "type", "label"]
        return reduce(DataFrame.unionByName, [p.select(*fields) for p in parts])

    def _fit_repairs(self, model: StringCleanerModel, labelled: DataFrame) -> None:
        counted = labelled.where(F.col("label") != "missing")
        demoted = O.demoted_columns(
            counted.where(F.col("type") != "sentence"), counted.where(F.col("label") == "anomaly")
        )
        for row in demoted.collect():
            model.types[row["col"]] = "string"
        open_rows = counted.join(F.broadcast(demoted.select("col")), "col", "left_anti")
        pairs = settle(O.repair_pairs(open_rows, self.plain_strings, self.drop_last, registry=self.registry))
        fills = O.random_fill(open_rows, pairs, self.seed, registry=self.registry)
        model.repairs = settle(pairs.select("col", "old", "new").unionByName(fills))
        model.repaired_cols = sorted(r["col"] for r in model.repairs.select("col").distinct().collect())
        number = F.when(F.col("type") == "integer", V.survives(F.col("value"), "bigint")).otherwise(
            V.survives(F.col("value"), "double")
        )
        typed = counted.where(F.col("type").isin(*V.TEXT_NUMBERS) & (F.col("label") == "normal"))
        lost = typed.where(~F.coalesce(number, F.lit(False))).select("col").distinct()
        model.kept_texts = {r["col"] for r in lost.collect()}

    def _fit_features(self, model: StringCleanerModel, repaired: DataFrame) -> None:
        groups = T.route_columns(model.types, self.registry)
        model.groups = groups
        recognised = [*groups["boolean"], *groups["date"], *groups["string_feature"]]
        kinds = {c: model.types[c] for c in recognised}
        model.rules = P.fit_features(repaired, kinds, self.dense, self.options)
        if groups["string"]:
            values = settle(V.value_table(repaired, groups["string"]))
            features = L.column_features(values, self.word_vectors, self.vector_dims)
            if self.ordinality_model is None:
                model.predictions = settle(L.by_rule(features))
            else:
                model.predictions = settle(L.predict(features, self.ordinality_model))
            for row in model.predictions.collect():
                model.ordinal[row["col"]] = row["prediction"] == 0

    def _fit_encoders(self, model: StringCleanerModel, processed: DataFrame) -> None:
        wanted = {c: "ordinal" if model.ordinal.get(c) else "nominal" for c in model.groups["string"]}
        for col in model.groups["string_feature"]:
            wanted |= {c: d for c, d in model.rules[col].directives.items() if d != "none"}
        counts = E.exact_below(processed, list(wanted))
        for col, directive in wanted.items():
            encoder = E.choose_encoder(directive, counts[col], model.balanced)
            if not counts[col]:
                continue
            mapping = settle(
                E.encoder_map(processed, col, encoder, self.target, self.valence, self.orders.get(col))
            )
            model.encoders[col] = (encoder, mapping, 0 if self.dense else E.vector_size(mapping))


class StringCleanerModel:
    """What ``fit`` has learnt. ``transform`` uses column expressions and joins with learnt
    maps only, so it also takes streaming tables (unless rows have to be imputed by rank)."""

    def __init__(self, settings: StringCleaner) -> None:
        self.settings = settings
        self.empty: list[str] = []
        self.types: dict[str, str] = {}
        self.first_types: dict[str, str] = {}
        self.tokens: dict[str, list[str]] = {}
        self.missing = M.MissingPlan("none", [])
        self.found: DataFrame | None = None
        self.inputs: DataFrame | None = None
        self.repairs: DataFrame | None = None
        self.repaired_cols: list[str] = []
        self.kept_texts: set[str] = set()
        self.groups: dict[str, list[str]] = {}
        self.rules: dict[str, P.FeatureRule] = {}
        self.predictions: DataFrame | None = None
        self.ordinal: dict[str, bool] = {}
        self.balanced = False
        self.target_codes: DataFrame | None = None
        self.encoders: dict[str, tuple[str, DataFrame, int]] = {}

    def transform(self, df: DataFrame) -> DataFrame:
        table = M.nan_to_null(V.normalise_spaces(df.drop(*self.empty)))
        table = self.missing.transform(M.tokens_to_null(table, self.tokens))
        table = self._process(self._repair(table))
        for col, (_, mapping, size) in self.encoders.items():
            table = E.encode_wide(table, col, mapping, size) if size else E.encode_dense(table, col, mapping)
        return self._arrange(table)

    def _repair(self, df: DataFrame) -> DataFrame:
        """Apply repairs, then give columns of numbers written as text their type, if all normal texts
        that were learnt survive it. A later text that is no such number must not vanish unseen."""

        def number(c: str) -> Column:
            kind = V.TEXT_NUMBERS[self.types[c]]
            return F.trim(c).cast(kind) if self.settings.strict_numbers else F.trim(c).try_cast(kind)

        table = O.apply_repairs(df, self.repairs, self.repaired_cols)
        return table.select(
            *[
                number(c).alias(c)
                if self.types.get(c) in V.TEXT_NUMBERS
                and c not in self.kept_texts
                and table.schema[c].dataType.typeName() == "string"
                else F.col(c)
                for c in table.columns
            ]
        )

    def _process(self, df: DataFrame) -> DataFrame:
        """Apply the rule of every recognised column, and code the target."""
        table = df
        for col, rule in self.rules.items():
            table = P.apply_feature(table, rule, self.settings.dense, self.settings.options)
        target = self.settings.target
        if self.target_codes is not None:
            codes = self.target_codes.select(target, F.col("code").alias("_code"))
            coded = V.join_map(table, target, codes)
            table = coded.select(*[F.col("_code").alias(c) if c == target else F.col(c) for c in table.columns])
        return table

    def _arrange(self, df: DataFrame) -> DataFrame:
        """Column groups in a fixed order: other, text, boolean, date, recognised text, target."""
        produced = {c: [c] for c in self.groups["string"]}
        for col, rule in self.rules.items():
            produced[col] = list(rule.directives)
        for col, (_, _, size) in self.encoders.items():
            if size:
                for outputs in produced.values():
                    if col in outputs:
                        at = outputs.index(col)
                        outputs[at : at + 1] = [f"{col}{i}" for i in range(size)]
        order = list(self.groups["other"])
        for group in ("string", "boolean", "date", "string_feature"):
            for col in self.groups[group]:
                order += produced.get(col, [col])
        if self.settings.target is not None:
            order.append(self.settings.target)
        return df.select(*order)

    def report(self) -> DataFrame:
        """``<col, unique_values, type, missing_values, outliers, ordinal, encoding>``."""
        spark = self.inputs.sparkSession
        cols = self.inputs.columns
        types = spark.createDataFrame([(c, self.types[c]) for c in cols], "col string, type string")
        long_cols = [c for c in cols if self.first_types.get(c) == "sentence"]
        digest = self.inputs.select(
            *[F.md5(F.col(c).cast("binary")).alias(c) if c in long_cols else F.col(c) for c in cols]
        )
        rows = R.profile(V.value_table(digest, cols), R.null_counts(self.inputs, cols), self.found, types)
        names = {
            "ordinal": "OrdinalEncoder",
            "target": "TargetEncoder",
            "similarity": "SimilarityEncoder",
            "gap": "GapEncoder",
            "minhash": "MinHashEncoder",
        }
        used = [
            (
                c,
                None if c not in self.ordinal else "Yes" if self.ordinal[c] else "No",
                names[self.encoders[c][0]] if c in self.encoders else "Custom" if c in self.rules else None,
            )
            for c in cols
        ]
        notes = spark.createDataFrame(used, "col string, ordinal string, encoding string")
        return rows.join(F.broadcast(notes), "col", "left")

