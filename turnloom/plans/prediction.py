"""Queries over classifier features, splits, prompts and metrics (inventory L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import labels as L
from turnloom.operators import evaluation as E
from turnloom.operators import features as X
from turnloom.operators.blocks import is_important
from turnloom.plans import bridge, oracle
from turnloom.plans.registry import registered
from turnloom.plans.tables import tables

TARGET = "patient"
SEED = 42


def r4(column):
    return F.round(column, 4)


def r6(column):
    return F.round(column, 6)


def labelled(spark, sf_dir) -> DataFrame:
    return tables(spark, sf_dir).hub().withColumn("label", F.when(is_important(TARGET), 1).otherwise(0))


# The parameter points that are tried: rows seen to each side follow from kernel and layers.
KERNELS, LAYERS, SMOOTHING, SCALES, THRESHOLDS = (3, 5), (1, 2), (0.5, 2.0), (0.5, 1.0), (0.4, 0.5, 0.6)
GRANULARITIES = ("groups", "raw")
REACH = 2


def reach_of(layers: int, kernel: int) -> int:
    return (X.receptive_field(layers, kernel) - 1) // 2


MAX_REACH = reach_of(max(LAYERS), max(KERNELS))


def context_scores(spark, sf_dir, granularity: str = "groups") -> DataFrame:
    """Log-odds of each row without its own transcript, for every smoothing and reach that is tried."""
    t = tables(spark, sf_dir)
    return t.once(f"context_scores_{granularity}", lambda: X.context_scores(
        labelled(spark, sf_dir), t.order, X.token(granularity), "label", MAX_REACH, SMOOTHING))


def predictions(spark, sf_dir) -> DataFrame:
    """Probabilities of the context model that has not seen the row's transcript."""
    chosen = F.filter("scores", lambda s: (s.smoothing == SMOOTHING[0]) & (s.reach == REACH))[0].score
    return context_scores(spark, sf_dir).select(
        "source_file", "pos", "label", F.round(X.probability(chosen), 9).alias("prob"))


oracle.add_view("model_rows", """
    SELECT 'groups' AS gran, source_file, pos, CAST(patient AS INT) AS label, lower(speaker) || '::' || da_group AS token FROM hub
    UNION ALL SELECT 'raw', source_file, pos, CAST(patient AS INT), lower(speaker) || '::' || proc_da FROM hub""")
oracle.add_view("model_contexts", f"""
    SELECT r.gran, r.source_file, r.pos, r.label, o, coalesce(t.token, CASE WHEN o < 0 THEN '<start>' ELSE '<end>' END) AS token
    FROM (SELECT *, unnest(range({-MAX_REACH}, {MAX_REACH + 1})) AS o FROM model_rows) r
    LEFT JOIN model_rows t ON t.gran = r.gran AND t.source_file = r.source_file AND t.pos = r.pos + o""")
oracle.add_view("model_weights", f"""
    WITH own AS (SELECT gran, source_file, o, token, count(*) AS n, sum(label) AS y FROM model_contexts GROUP BY ALL),
    total AS (SELECT gran, o, token, sum(n) AS n, sum(y) AS y FROM own GROUP BY ALL),
    file AS (SELECT gran, source_file, count(*) AS n, sum(label) AS y FROM model_rows GROUP BY ALL),
    every AS (SELECT gran, count(*) AS n, sum(label) AS y, count(DISTINCT token) + 1 AS v FROM model_rows GROUP BY ALL)
    SELECT own.gran, own.source_file, own.o, own.token, a,
           ln((t.y - own.y + a) / (e.y - f.y + a * v)) - ln((t.n - own.n - t.y + own.y + a) / (e.n - f.n - e.y + f.y + a * v)) AS w
    FROM own JOIN total t ON t.gran = own.gran AND t.o = own.o AND t.token = own.token
    JOIN file f ON f.gran = own.gran AND f.source_file = own.source_file JOIN every e ON e.gran = own.gran,
    (VALUES {", ".join(f"({a}::DOUBLE)" for a in SMOOTHING)}) s(a)""")
oracle.add_view("model_scores", f"""
    SELECT gran, source_file, pos, label, a, reach, sum(w) AS score
    FROM model_contexts JOIN model_weights USING (gran, source_file, o, token),
         (SELECT DISTINCT unnest([{", ".join(str(reach_of(n, k)) for n in LAYERS for k in KERNELS)}]) AS reach)
    WHERE abs(o) <= reach GROUP BY ALL""")


oracle.add_view("vocabulary", """
    SELECT token, row_number() OVER (ORDER BY first_file, first_pos) + 1 AS idx FROM (
      SELECT lower(speaker) || '::' || da_group AS token, min(source_file) AS first_file,
             arg_min(pos, (source_file, pos)) AS first_pos FROM hub GROUP BY ALL)""")


@registered("l01_vocabulary", """
    SELECT 'joint' AS kind, token, idx FROM vocabulary
    UNION ALL SELECT 'label', da_group, row_number() OVER (ORDER BY first_file, first_pos) + 1 FROM (
      SELECT da_group, min(source_file) AS first_file, arg_min(pos, (source_file, pos)) AS first_pos FROM hub GROUP BY ALL)""")
def vocabulary(spark, sf_dir):
    """Joint speaker::label tokens (L1) and label-only tokens (L2)."""
    hub = tables(spark, sf_dir).hub()
    parts = [
        X.vocabulary(hub, X.token("groups", with_speaker)).select(F.lit(kind).alias("kind"), "token", "idx")
        for kind, with_speaker in (("joint", True), ("label", False))
    ]
    return parts[0].unionByName(parts[1])


@registered("l03_encoded_rows", """
    SELECT source_file, pos, coalesce(idx, 1) AS token_id, CASE WHEN speaker = 'Therapist' THEN 0.0 ELSE 1.0 END::DOUBLE AS speaker_channel,
           round(CASE WHEN hi = lo THEN 0.5 ELSE (clock - lo) / (hi - lo) END, 6) AS ts, CAST(patient AS INT) AS label
    FROM (SELECT *, min(clock) OVER (PARTITION BY source_file) AS lo, max(clock) OVER (PARTITION BY source_file) AS hi FROM (
      SELECT *, CAST(split_part(timestamp, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(timestamp, ':', 2) AS DOUBLE) * 60
        + CAST(split_part(timestamp, ':', 3) AS DOUBLE) AS clock FROM hub))
    LEFT JOIN vocabulary ON token = lower(speaker) || '::' || da_group""")
def encoded_rows(spark, sf_dir):
    """Rows as token ids over the whole vocabulary."""
    hub = tables(spark, sf_dir).hub()
    tokens = X.token("groups")
    vocab = X.vocabulary(hub, tokens)
    timed = X.normalise_time(
        hub.withColumn("seconds", L.clock_seconds(F.col("timestamp"))),
        tables(spark, sf_dir).order, "seconds")
    return X.encode(timed, tokens, vocab, TARGET).withColumn("ts", r6("ts"))


@registered("l04_expanded_labels", """
    SELECT source_file, pos, max(CAST(patient AS INT)) OVER (PARTITION BY source_file ORDER BY pos
      ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS expanded FROM hub""")
def expanded_labels(spark, sf_dir):
    return X.expand_labels(labelled(spark, sf_dir), tables(spark, sf_dir).order, "label", 2, 1).select(
        "source_file", "pos", "expanded")


@registered("l05_loss_mask", f"""
    SELECT source_file, pos, patient OR rank <= greatest(1, floor(n * 0.2)) AS in_loss FROM (
      SELECT *, count(*) OVER (PARTITION BY source_file, patient) AS n, row_number() OVER (PARTITION BY source_file, patient
               ORDER BY md5('{SEED}:' || source_file || ':' || pos)) AS rank FROM hub)""")
def loss_mask(spark, sf_dir):
    order = tables(spark, sf_dir).order
    return X.loss_mask(labelled(spark, sf_dir), order, "label", 0.2, SEED).select(
        "source_file", "pos", "in_loss")


@registered("l07_folds", """
    SELECT fold, n_test, n_test_pos, n - n_test AS n_train, p - n_test_pos AS n_train_pos,
           round((n - n_test - p + n_test_pos) / greatest(p - n_test_pos, 1), 6) AS pos_weight
    FROM (SELECT source_file AS fold, count(*) AS n_test, count(*) FILTER (WHERE patient) AS n_test_pos FROM hub GROUP BY ALL),
         (SELECT count(*) AS n, count(*) FILTER (WHERE patient) AS p FROM hub)""")
def folds(spark, sf_dir):
    """Leave-one-transcript-out folds (L7) with their positive weight."""
    return X.fold_table(labelled(spark, sf_dir), "label").withColumn("pos_weight", r6("pos_weight"))


oracle.add_view("predicted", f"""
    SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
      SELECT source_file, pos, label, round(1 / (1 + exp(-score)), 9) AS prob FROM model_scores
      WHERE gran = 'groups' AND a = {SMOOTHING[0]} AND reach = {REACH})""")


def _confusion_sql(rows: str, by: str) -> str:
    return f"""
      SELECT {by}, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn,
             count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn
      FROM {rows} GROUP BY ALL"""


_F1 = "CASE WHEN {0} + fp + fn = 0 THEN 0 ELSE 2 * {0} / (2 * {0} + fp + fn) END"
_F1_POS, _F1_NEG = _F1.format("tp"), _F1.format("tn")
_MACRO = (f"CASE WHEN tp + fp + fn = 0 THEN {_F1_NEG} WHEN tn + fp + fn = 0 THEN {_F1_POS} "
          f"ELSE ({_F1_POS} + {_F1_NEG}) / 2 END")
_PRECISION = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END"
_RECALL = "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END"
_WEIGHTED = f"({_F1_POS} * (tp + fn) + {_F1_NEG} * (tn + fp)) / (tp + tn + fp + fn)"


def _folds_sql(rows: str, by: str) -> str:
    return f"""
      SELECT {by}, tp + tn + fp + fn AS n_das, tp + fn AS n_important, round(100.0::DOUBLE * (tp + fn) / (tp + tn + fp + fn) + 1e-9, 1) AS pct_important,
             tp + fp AS n_pred_important, round({_F1_POS} + 1e-9, 4) AS f1_important, round({_MACRO} + 1e-9, 4) AS f1_macro,
             round({_PRECISION} + 1e-9, 4) AS precision_imp, round({_RECALL} + 1e-9, 4) AS recall_imp
      FROM ({_confusion_sql(rows, by)})"""


def _thresholded(spark, sf_dir, at=0.5):
    return predictions(spark, sf_dir).withColumn("pred", E.threshold(F.col("prob"), at))


@registered("l08_thresholded", "SELECT source_file, pos, label, prob, pred FROM predicted")
def thresholded(spark, sf_dir):
    return _thresholded(spark, sf_dir)


@registered("l09_fold_metrics", _folds_sql("predicted", "source_file").replace(
    "SELECT source_file, tp + tn", "SELECT source_file AS transcript, tp + tn", 1))
def fold_metrics(spark, sf_dir):
    return E.fold_metrics(_thresholded(spark, sf_dir))


_POINT = ["p_granularity", "p_layers", "p_kernel", "p_smoothing", "p_scale", "p_threshold"]
_KEYS = ", ".join(_POINT)
oracle.add_view("tried", f"""
    SELECT source_file, pos, label, gran AS p_granularity, p_layers, p_kernel, a AS p_smoothing, p_scale, p_threshold,
           CASE WHEN round(1 / (1 + exp(-(score + ln(p_scale)))), 9) >= p_threshold THEN 1 ELSE 0 END AS pred
    FROM model_scores JOIN (VALUES {", ".join(f"({n}, {k}, {reach_of(n, k)})" for n in LAYERS for k in KERNELS)}) p(p_layers, p_kernel, r)
      ON r = reach, (VALUES {", ".join(f"({x}::DOUBLE)" for x in SCALES)}) s(p_scale),
      (VALUES {", ".join(f"({x}::DOUBLE)" for x in THRESHOLDS)}) t(p_threshold)""")
oracle.add_view("tried_metrics", f"""
    SELECT {_KEYS}, pooled_f1_imp, pooled_f1_balanced, pooled_f1_weighted, mean_f, std_f, mean_b FROM (
      SELECT {_KEYS}, {_F1_POS} AS pooled_f1_imp, {_MACRO} AS pooled_f1_balanced, {_WEIGHTED} AS pooled_f1_weighted
      FROM ({_confusion_sql('tried', _KEYS)}))
    JOIN (SELECT {_KEYS}, avg(f1_important) AS mean_f, stddev_pop(f1_important) AS std_f, avg(f1_macro) AS mean_b
          FROM ({_folds_sql('tried', _KEYS + ', source_file')}) GROUP BY ALL) USING ({_KEYS})""")
_METRICS = """round(pooled_f1_imp + 1e-9, 4) AS pooled_f1_imp, round(pooled_f1_balanced + 1e-9, 4) AS pooled_f1_balanced,
           round(pooled_f1_weighted + 1e-9, 4) AS pooled_f1_weighted, round(mean_f, 6) AS mean_fold_f1_imp, round(std_f, 6) AS std_fold_f1_imp,
           round(mean_b, 6) AS mean_fold_f1_balanced"""
_METRIC_NAMES = ["pooled_f1_imp", "pooled_f1_balanced", "pooled_f1_weighted", "mean_fold_f1_imp",
                 "std_fold_f1_imp", "mean_fold_f1_balanced"]


def _rounded_metrics():
    """Means of folds keep six digits: the folds' scores have four, so four would often be a tie."""
    return [(E.rounded(F.col(c), 4) if c.startswith("pooled") else r6(c)).alias(c) for c in _METRIC_NAMES]


def _tried(spark, sf_dir) -> DataFrame:
    """Metrics of every parameter point, all from the same counts and one pass over the scored rows."""
    parts = [context_scores(spark, sf_dir, g).withColumn("p_granularity", F.lit(g)) for g in GRANULARITIES]
    fields = F.array(*[F.struct(F.lit(n).alias("p_layers"), F.lit(k).alias("p_kernel"), F.lit(reach_of(n, k)).alias("reach"))
                       for n in LAYERS for k in KERNELS])
    values = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    rows = (
        parts[0].unionByName(parts[1]).select("source_file", "label", "p_granularity", F.inline("scores"))
        .withColumn("f", F.explode(F.filter(fields, lambda f: f.reach == F.col("reach")))).select("*", "f.p_layers", "f.p_kernel")
        .withColumn("p_scale", values(SCALES))
        .withColumn("prob", F.round(X.probability(F.col("score"), F.col("p_scale")), 9))
        .withColumn("p_threshold", values(THRESHOLDS))
        .withColumn("pred", E.threshold(F.col("prob"), F.col("p_threshold"))).withColumnRenamed("smoothing", "p_smoothing")
    )
    return E.pooled_metrics(rows, *_POINT)


@registered("l10_pooled_metrics", f"SELECT {_KEYS}, {_METRICS} FROM tried_metrics")
def pooled_metrics(spark, sf_dir):
    """Pooled and fold metrics of the model at every parameter point."""
    return _tried(spark, sf_dir).select(*_POINT, *_rounded_metrics())


@registered("l11_grid_ranking", f"""
    SELECT {_KEYS}, p_layers * (p_kernel - 1) + 1 AS receptive_field, {_METRICS} FROM tried_metrics
    ORDER BY round(mean_f, 9) DESC, round(std_f, 9), {_KEYS} LIMIT 5""")
def grid_ranking(spark, sf_dir):
    """The best five points of a grid over granularity, layers, kernel, smoothing, weight and threshold."""
    field = F.col("p_layers") * (F.col("p_kernel") - 1) + 1
    return E.rank_grid(_tried(spark, sf_dir)).select(
        *_POINT, field.alias("receptive_field"), *_rounded_metrics())


@registered("l12_context_classifier", """
    SELECT gran AS granularity, a AS smoothing, reach, source_file, pos, label, round(1 / (1 + exp(-score)), 6) AS prob FROM model_scores""")
def context_classifier(spark, sf_dir):
    """Importance per row from the labels and speakers around it, scored without the row's own
    transcript, at every granularity, smoothing and reach that is tried."""
    parts = [context_scores(spark, sf_dir, g).withColumn("granularity", F.lit(g)) for g in GRANULARITIES]
    tried = sorted({reach_of(n, k) for n in LAYERS for k in KERNELS})
    return parts[0].unionByName(parts[1]).select(
        "granularity", "source_file", "pos", "label", F.inline("scores")).filter(F.col("reach").isin(*tried)).select(
        "granularity", "smoothing", "reach", "source_file", "pos", "label", r6(X.probability(F.col("score"))).alias("prob"))


oracle.add_view("patients", f"""
    SELECT patient_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || patient_id), patient_id) <= 5 THEN 'train' ELSE 'test' END AS part
    FROM (SELECT DISTINCT regexp_extract(source_file, 'AC([0-9]{{2}})', 1) AS patient_id FROM hub)""")


@registered("l13_patient_split", "SELECT patient_id, part FROM patients")
def patient_split(spark, sf_dir):
    return X.split_by_patient(tables(spark, sf_dir).hub(), 5, SEED)


def _line(offset: int) -> str:
    if offset == 0:
        return "'>>> ' || line"
    function, pad = ("lag", X.START_LINE) if offset < 0 else ("lead", X.END_LINE)
    return f"coalesce({function}(line, {abs(offset)}) OVER (PARTITION BY source_file ORDER BY pos), '{pad}')"


oracle.add_view("contexts", f"""
    SELECT source_file, pos, CAST(patient AS INT) AS label, da_group, speaker, spoken_text,
      concat_ws(chr(10), '{X.PRECEDING}', {_line(-2)}, {_line(-1)}, '{X.TARGET_LINE}', {_line(0)}, '{X.FOLLOWING}', {_line(1)}, {_line(2)}) AS context
    FROM (SELECT *, speaker || ': [' || da_group || '] "' || trim(spoken_text) || '"' AS line FROM hub)""")


def _contexts(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir)
    return X.context_window(labelled(spark, sf_dir), t.order, "groups", 2).withColumn(
        "patient_id", L.patient_in_name(F.col("source_file")))


@registered("l14_context_windows", "SELECT source_file, pos, label, context FROM contexts")
def context_windows(spark, sf_dir):
    return _contexts(spark, sf_dir).select("source_file", "pos", "label", "context")


oracle.add_view("examples", f"""
    SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || source_file || ':' || pos), source_file, pos) AS rank
    FROM contexts WHERE label = 1 AND regexp_extract(source_file, 'AC([0-9]{{2}})', 1) IN (SELECT patient_id FROM patients WHERE part = 'train')""")


def _split_contexts(spark, sf_dir) -> DataFrame:
    contexts = _contexts(spark, sf_dir)
    parts = X.split_by_patient(tables(spark, sf_dir).hub(), 5, SEED)
    return contexts.join(F.broadcast(parts), "patient_id")


def _examples(spark, sf_dir, n: int) -> DataFrame:
    return X.positive_examples(_split_contexts(spark, sf_dir).filter("part = 'train'"), n, SEED)


@registered("l15_positive_examples", "SELECT source_file, pos, context FROM examples WHERE rank <= 16")
def positive_examples(spark, sf_dir):
    """Pool of 4 x 4 examples from training patients."""
    return _examples(spark, sf_dir, 16).select("source_file", "pos", "context")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


oracle.add_view("prompt_rows", f"""
    SELECT source_file, pos, label, da_group, speaker, spoken_text, {_sql_text(X.EXAMPLES_INTRO)} || chr(10) || shown || chr(10)
             || {_sql_text(X.TASK)} || chr(10) || context || chr(10) || chr(10) || 'Classification:' AS prompt
    FROM contexts, (SELECT string_agg('Example ' || rank || ':' || chr(10) || context || chr(10) || 'Classification: important' || chr(10),
                    chr(10) ORDER BY rank) AS shown FROM examples WHERE rank <= 4)
    WHERE regexp_extract(source_file, 'AC([0-9]{{2}})', 1) IN (SELECT patient_id FROM patients WHERE part = 'test')""")


def _prompts(spark, sf_dir) -> DataFrame:
    # four texts: the examples shown in every prompt
    shown = [r.context for r in _examples(spark, sf_dir, 4).select("context").collect()]
    return X.prompts(_split_contexts(spark, sf_dir).filter("part = 'test'"), shown)


@registered("l16_prompts", "SELECT source_file, pos, label, md5(prompt) AS prompt_digest, length(prompt) AS n_characters FROM prompt_rows")
def prompts(spark, sf_dir):
    """Few-shot prompt of every test row, shown as digest and length."""
    return _prompts(spark, sf_dir).select(
        "source_file", "pos", "label", F.md5("prompt").alias("prompt_digest"),
        F.length("prompt").cast("long").alias("n_characters"))


oracle.add_view("answers", """
    SELECT *, CASE event WHEN 'view' THEN ' Not Important.' WHEN 'click' THEN 'IMPORTANT' WHEN 'error' THEN 'Classification: important'
             WHEN 'signup' THEN 'it is not important' ELSE 'no idea' END AS response FROM (SELECT *, split_part(spoken_text, ' ', 1) AS event FROM hub)""")


@registered("l17_parsed_responses", """
    SELECT source_file, pos, CASE WHEN event IN ('click', 'error') THEN 1 ELSE 0 END AS pred, event <> 'purchase' AS parsed FROM answers""")
def parsed_responses(spark, sf_dir):
    event = F.split("spoken_text", " ")[0]
    response = (
        F.when(event == "view", " Not Important.").when(event == "click", "IMPORTANT")
        .when(event == "error", "Classification: important").when(event == "signup", "it is not important")
        .otherwise("no idea")
    )
    pred, parsed = E.parse_response(response)
    return tables(spark, sf_dir).hub().select("source_file", "pos", pred.alias("pred"), parsed.alias("parsed"))


@registered("l18_evaluation", f"""
    SELECT name, tp, tn, fp, fn, round({_RECALL} + 1e-9, 4) AS sensitivity, round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END + 1e-9, 4) AS specificity,
           round({_PRECISION} + 1e-9, 4) AS precision, round({_F1_POS} + 1e-9, 4) AS f1_important, round({_MACRO} + 1e-9, 4) AS f1_macro, round({_WEIGHTED} + 1e-9, 4) AS f1_weighted
    FROM ({_confusion_sql("(SELECT 'importance' AS name, label, pred FROM predicted UNION ALL SELECT 'quality', quality, 1 - toxic FROM labels)", "name")})""")
def evaluation(spark, sf_dir):
    rows = _thresholded(spark, sf_dir).select(F.lit("importance").alias("name"), "label", "pred").unionByName(
        bridge.read(spark, sf_dir, "labels").select(
            F.lit("quality").alias("name"), F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred")))
    names = ["sensitivity", "specificity", "precision", "f1_important", "f1_macro", "f1_weighted"]
    return E.evaluate(rows, "label", "pred", "name").select(
        "name", "tp", "tn", "fp", "fn", *[E.rounded(F.col(c), 4).alias(c) for c in names])


def load_line_model():
    """Stands in for a language model: important where the target line is a question."""

    def answer(texts):
        out = []
        for text in texts:
            target = text.rsplit(">>> ", 1)[1].split("\n", 1)[0]
            out.append("important" if "questions]" in target else "not important")
        return out

    return answer


@registered("l19_predictions", """
    SELECT source_file, regexp_extract(source_file, 'AC([0-9]{2})', 1) AS patient_id, pos, da_group AS da, lower(speaker) AS speaker, spoken_text AS text, label,
           CASE WHEN da_group = 'canonical_questions' THEN 1 ELSE 0 END AS pred,
           CASE WHEN da_group = 'canonical_questions' THEN 'important' ELSE 'not important' END AS response
    FROM prompt_rows""")
def prediction_table(spark, sf_dir):
    """Prompts answered by the supplied model, parsed, one row per dialogue act."""
    rows = _prompts(spark, sf_dir).select(
        "source_file", "patient_id", "pos", F.col("da_group").alias("da"),
        L.normalise_speaker(F.col("speaker")).alias("speaker"), F.col("spoken_text").alias("text"),
        "label", "prompt")
    answered = E.ask(rows, load_line_model, [c for c in rows.columns if c != "prompt"])
    pred, _ = E.parse_response(F.col("response"))
    return answered.withColumn("pred", pred)


@registered("l20_class_balance", """
    SELECT source_file, count(*) AS n_das, count(*) FILTER (WHERE patient) AS n_important,
           round(100.0::DOUBLE * count(*) FILTER (WHERE patient) / count(*), 1) AS pct_important FROM hub GROUP BY ALL""")
def class_balance(spark, sf_dir):
    return X.class_balance(labelled(spark, sf_dir), "label")
