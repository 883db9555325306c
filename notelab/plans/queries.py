"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or what Spark derives from them) in full.  Output columns
carry explicit names and types so that the DuckDB oracle can produce the same schema.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sections as S
from ..functions import text as T
from ..functions.vocab import MAX_TOKENS, SPAN_OFFSET, TAKEN, TITLES
from ..operators import annotations as A
from ..operators import dataset as DS
from ..operators import notes as N
from ..session import spread, stage, table
from ..sources.files import union_rounds
from . import notes_to_sections as P


def _big(*names):
    return [F.col(n).cast("bigint").alias(n.split(".")[-1]) for n in names]


# ---------------------------------------------------------------- scans / projections

def _docs(spark, sf):
    return table(spark, sf, "documents")


def q_note_body(spark, sf):
    docs = _docs(spark, sf)
    return docs.select("doc_id", T.note_body(F.col("text")).alias("body"))


def q_token_count(spark, sf):
    docs = _docs(spark, sf)
    return docs.select("doc_id", T.token_count(F.col("text")).cast("bigint").alias("n_tokens"))


def q_file_meta(spark, sf):
    return P.notes(spark, sf).select("file", "round", "mrn", *_big("visit_no", "length"))


def q_lower_notes(spark, sf):
    return P.notes(spark, sf).select("file", "round", T.lower_text(F.col("note_des")).alias("note_des_lower"))


def q_clean_text(spark, sf):
    docs = spread(_docs(spark, sf).select("doc_id", "text"))
    return docs.select("doc_id", T.clean_text("text", max_tokens=MAX_TOKENS).alias("clean"))


def q_clean_conversations(spark, sf):
    conv = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return conv.select("conv_id", "turn", T.clean_text("text", max_tokens=MAX_TOKENS).alias("clean"))


def q_union_rounds(spark, sf):
    raw, _ = P.raw_inputs(spark, sf)
    conv = table(spark, sf, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".txt")).alias("file"),
        F.lit("conversations").alias("round"), F.col("text").alias("note_des"), "role")
    u = union_rounds([raw, conv])
    return u.select("file", "round", "role", T.token_count(F.col("note_des")).cast("bigint").alias("length"))


# ---------------------------------------------------------------- annotations

def _xmi(spark, sf):
    return P.raw_inputs(spark, sf)[1]


def q_annotation_keys(spark, sf):
    return A.with_keys(_xmi(spark, sf)).select("xmi", "round", "file", "anon_id")


def q_xmi_fragments(spark, sf):
    return A.xmi_fragments(_xmi(spark, sf)).select("xmi", "round", F.col("pos").cast("bigint").alias("pos"), "fragment")


def q_xmi_attributes(spark, sf):
    return A.xmi_attributes(_xmi(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


def q_doc_tags(spark, sf):
    return A.doc_tags(_xmi(spark, sf)).select("xmi", "round", F.array_join("tags", ",").alias("tags"))


def _wide(spark, sf):
    return A.annotations_wide(_xmi(spark, sf))


def q_annotations_wide(spark, sf):
    from ..functions.vocab import TAG_VOCAB
    return _wide(spark, sf).select("xmi", "file", "anon_id", "round", F.array_join("other_tags", ",").alias("other_tags"),
                                   *_big(*TAG_VOCAB, "SE_present", "SE_absent", "SE_inquiry"))


def q_se_flags(spark, sf):
    return _wide(spark, sf).select("xmi", "round", *_big("SE_present", "SE_absent", "SE_inquiry"))


def q_inquiry_counts(spark, sf):
    return A.inquiry_counts(_wide(spark, sf)).select(*_big("SE_inquiry", "count"))


def q_tag_subset(spark, sf):
    return A.tag_subset(A.spans(_xmi(spark, sf))).select("round", "file", "tag", *_big("begin", "end"))


def q_span_rejects(spark, sf):
    return A.span_rejects(A.spans(_xmi(spark, sf))).select("no_tag", "no_position", *_big("n"))


def _round_frames(df):
    """The rounds' tables as they come from their folders: later rounds ("-b") lack the column of other tags."""
    later = F.col("round").endswith("-b")
    return [df.where(~later), df.where(later).drop("other_tags")]


def q_union_wide(spark, sf):
    from ..functions.vocab import TAG_VOCAB
    return union_rounds(_round_frames(_wide(spark, sf))).select(
        "xmi", "round", F.array_join("other_tags", ",").alias("other_tags"), *_big(*TAG_VOCAB, "SE_inquiry"))


def q_union_spans(spark, sf):
    return union_rounds(_round_frames(A.spans(_xmi(spark, sf)))).select("round", "file", "tag", *_big("begin", "end"))


# ---------------------------------------------------------------- notes ⟶ annotations, sections

def _joined(spark, sf):
    raw, xmi = P.raw_inputs(spark, sf)
    return P.joined_notes(N.notes_table(raw), xmi)


def q_notes_right_join(spark, sf):
    return _joined(spark, sf).select("xmi", "file", "round", "mrn", *_big("visit_no", "length", "SE_inquiry"),
                                     F.col("note_des").isNotNull().alias("has_note"))


def _low(spark, sf):
    return _joined(spark, sf).withColumn("note_des_lower", T.lower_text(F.col("note_des")))


def _staged(spark, sf):
    """The section finder's stages, as the pipeline runs them."""
    return S.with_sections(_low(spark, sf), "note_des_lower", keep_titles=True)


def q_section_route(spark, sf):
    return _staged(spark, sf).select("xmi", "round", F.col("_third").alias("third"))


def _titles(staged, stage_name):
    return (staged.where(F.col("_third").isNotNull()).select("xmi", "round", F.explode_outer(stage_name).alias("t")).where(F.col("t").isNotNull())
            .select("xmi", "round", F.col("t.section_name").alias("section_name"),
                    *[F.col(f"t.{c}").cast("bigint").alias(c) for c in ("start_title", "end_title")]))


def q_title_spans(spark, sf):
    return _titles(_staged(spark, sf), "_found")


def q_span_overlap(spark, sf):
    rest = "greatest(size(_found) - 1, 0)"
    pairs = f"zip_with(slice(_found, 1, {rest}), slice(_found, 2, {rest}), (p, x) -> {S.overlap_sql('p', 'x')})"
    return (_staged(spark, sf).where(F.col("_third").isNotNull()).select("xmi", "round", F.posexplode_outer(F.expr(pairs)).alias("i", "overlap"))
            .where(F.col("i").isNotNull())
            .select("xmi", "round", (F.col("i") + 1).cast("bigint").alias("k"), F.col("overlap").cast("bigint").alias("overlap")))


def q_overlap_resolve(spark, sf):
    return _titles(_staged(spark, sf), "_kept")


def _sectioned(spark, sf):
    return N.add_sections(_joined(spark, sf))


def q_sectionize(spark, sf):
    sec = _sectioned(spark, sf)
    return (sec.select("xmi", "round", F.explode_outer("sections").alias("s")).where(F.col("s").isNotNull())
            .select("xmi", "round", F.col("s.section_name").alias("section_name"),
                    *[F.col(f"s.{c}").cast("bigint").alias(c)
                      for c in ("start_title", "end_title", "start_section", "end_section")]))


def q_section_bounds(spark, sf):
    sec = _sectioned(spark, sf)
    return (sec.select("xmi", "round", F.explode_outer("sections").alias("s")).where(F.col("s").isNotNull())
            .select("xmi", "round", F.col("s.section_name").alias("section_name"),
                    F.col("s.start_section").cast("bigint").alias("start_section"),
                    F.col("s.end_section").cast("bigint").alias("end_section"),
                    (F.col("s.end_section") - F.col("s.start_section")).cast("bigint").alias("n_chars")))


def q_section_extract(spark, sf):
    sec = _sectioned(spark, sf)
    return (sec.select("xmi", "round", F.posexplode_outer(S.section_texts(F.col("note_des_lower"), F.col("sections"))).alias("idx", "text"))
            .where(F.col("idx").isNotNull()).select("xmi", "round", F.col("idx").cast("bigint").alias("idx"), "text"))


def _low_notes(spark, sf):
    notes = spread(P.notes(spark, sf).select("file", "round", "note_des"))
    return notes.withColumn("low", T.lower_text(F.col("note_des")))


def q_title_list(spark, sf):
    """O1, P11, W1, W2 with 30 titles over every note."""
    found = S.with_title_sections(_low_notes(spark, sf), "low", TITLES).select("file", "round", F.explode_outer("sections").alias("s")).where(F.col("s").isNotNull())
    return found.select("file", "round", "s.section_name", *_big("s.start_title", "s.end_title", "s.start_section", "s.end_section"))


def q_title_list_extract(spark, sf):
    """P15, P16 with 30 titles, eleven sections to take, empty ones kept."""
    found = S.extract(_low_notes(spark, sf), "low", TITLES, TAKEN, delete_empty=False)
    texts = found.select("file", "round", F.posexplode_outer("section_texts").alias("idx", "text")).where(F.col("idx").isNotNull())
    return texts.select("file", "round", *_big("idx"), "text")


def q_section_offsets(spark, sf):
    return _sectioned(spark, sf).select("xmi", "round", *_big(*N.OFFSET_COLUMNS))


def q_section_assign(spark, sf):
    return _sectioned(spark, sf).select("xmi", "round", "subjective", "objective", "assessment")


def q_clean_sections(spark, sf):
    return N.clean_sections(_sectioned(spark, sf)).select(
        "xmi", "round", "subjective_clean1", "objective_clean1", "assessment_clean1")


def _labelled(spark, sf):
    return P.labelled_from_tables(spark, sf)


def q_interval_overlap(spark, sf):
    """P13 for every span of a note: the distinct positions come with the note's row, so no join is needed."""
    rows = N.add_sections(_joined(spark, sf)).select(
        "xmi", "round", "subjective_start", "subjective_end", "objective_start", "objective_end", "assessment_start", "assessment_end",
        F.explode("label_spans").alias("s"))
    b, e = F.col("s.begin") - SPAN_OFFSET, F.col("s.end") - SPAN_OFFSET

    def ov(n):
        s, t = F.col(f"{n}_start"), F.col(f"{n}_end")
        return F.when(s.isNotNull(), S.interval_overlap(b, e, s, t)).otherwise(0).cast("bigint")

    return rows.select("xmi", "round", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"), ov("subjective").alias("so"),
                       ov("objective").alias("oo"), ov("assessment").alias("ao"))


def q_label_sections(spark, sf):
    return _labelled(spark, sf).select("xmi", "file", "round", *_big("subj_label", "obj_label", "asses_label"))


def q_unpivot_sections(spark, sf):
    return DS.unpivot_sections(_labelled(spark, sf)).select(
        "xmi", "round", "note_id", "mrn", "section", "text", F.col("y").cast("bigint").alias("y"))


def q_min_tokens(spark, sf):
    rows = DS.min_tokens(DS.unpivot_sections(_labelled(spark, sf)))
    return rows.select("xmi", "round", "note_id", "section", T.token_count(F.col("text")).cast("bigint").alias("n_tokens"),
                       F.col("y").cast("bigint").alias("y"))


def q_exclude_groups(spark, sf):
    return P.training_rows(spark, sf).select("xmi", "round", "note_id", "section", "mrn", F.col("y").cast("bigint").alias("y"))


QUERIES = {
    "note_body": q_note_body,
    "token_count": q_token_count,
    "file_meta": q_file_meta,
    "lower_notes": q_lower_notes,
    "clean_text": q_clean_text,
    "clean_conversations": q_clean_conversations,
    "union_rounds": q_union_rounds,
    "annotation_keys": q_annotation_keys,
    "xmi_fragments": q_xmi_fragments,
    "xmi_attributes": q_xmi_attributes,
    "doc_tags": q_doc_tags,
    "annotations_wide": q_annotations_wide,
    "se_flags": q_se_flags,
    "inquiry_counts": q_inquiry_counts,
    "tag_subset": q_tag_subset,
    "span_rejects": q_span_rejects,
    "union_wide": q_union_wide,
    "union_spans": q_union_spans,
    "notes_right_join": q_notes_right_join,
    "section_route": q_section_route,
    "title_spans": q_title_spans,
    "span_overlap": q_span_overlap,
    "overlap_resolve": q_overlap_resolve,
    "sectionize": q_sectionize,
    "section_bounds": q_section_bounds,
    "section_extract": q_section_extract,
    "title_list": q_title_list,
    "title_list_extract": q_title_list_extract,
    "section_offsets": q_section_offsets,
    "section_assign": q_section_assign,
    "clean_sections": q_clean_sections,
    "interval_overlap": q_interval_overlap,
    "label_sections": q_label_sections,
    "unpivot_sections": q_unpivot_sections,
    "min_tokens": q_min_tokens,
    "exclude_groups": q_exclude_groups,
}


def q_flagship(spark, sf):
    """Training rows per (section, label) after all filters."""
    rows = P.training_rows(spark, sf).withColumn("y", F.col("y").cast("bigint"))
    return rows.groupBy("section", "y").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                            F.countDistinct("mrn").cast("bigint").alias("n_patients"))


QUERIES["flagship"] = q_flagship


# ---------------------------------------------------------------- folds, splits, metrics, features

from ..operators import balance as BA  # noqa: E402
from ..operators import embed as E  # noqa: E402
from ..operators import folds as FO  # noqa: E402
from ..operators import metrics as M  # noqa: E402
from ..operators import subwords as SW  # noqa: E402
from ..operators import vectors as V  # noqa: E402

FOLD_SEED = 22


def _labels(spark, sf):
    """Training rows without their texts, the only columns that folds and metrics read."""
    return FO.with_patient(P.training_rows(spark, sf).select("xmi", "round", "note_id", "section", "mrn", "y"))


def q_group_class_counts(spark, sf):
    return FO.group_class_counts(_labels(spark, sf)).select("patient", *_big("n", "pos"))


def q_group_folds(spark, sf):
    return FO.group_folds(FO.group_class_counts(_labels(spark, sf)), seed=FOLD_SEED).select("patient", *_big("fold", "n", "pos"))


def q_balanced_folds(spark, sf):
    """M6 by exchanges: folds of two split numbers."""
    found = BA.balanced_folds(FO.group_class_counts(_labels(spark, sf)), (FOLD_SEED, FOLD_SEED + 1))
    return found.select(*_big("random_number"), "patient", *_big("fold", "n", "pos"))


def _split_rows(spark, sf):
    rows = stage(_labels(spark, sf))
    return FO.assign_splits(rows, FO.group_folds(FO.group_class_counts(rows), seed=FOLD_SEED))


def q_split_assign(spark, sf):
    return _split_rows(spark, sf).select("xmi", "round", "note_id", "section", "mrn", *_big("y", "fold"), "split")


def q_balance_gate(spark, sf):
    return FO.balance_gate(_split_rows(spark, sf))


def _scored(spark, sf):
    return _split_rows(spark, sf).withColumn("score", M.hash_score(F.col("round"), F.col("xmi"), F.col("section")))


def q_note_truth(spark, sf):
    return M.note_truth(_split_rows(spark, sf)).select("split", "xmi", "round", *_big("y"))


def q_note_scores(spark, sf):
    return M.note_scores(_scored(spark, sf)).select("split", "xmi", "round", *_big("y"), F.round("score", 6).alias("score"))


def q_split_counts(spark, sf):
    rows = stage(_split_rows(spark, sf))
    return M.split_counts(rows, M.note_truth(rows))


def q_auc_section(spark, sf):
    return M.exact_auc(_scored(spark, sf)).select("split", F.round("auc", 6).alias("auc"))


def q_auc_note(spark, sf):
    return M.exact_auc(M.note_scores(_scored(spark, sf))).select("split", F.round("auc", 6).alias("auc"))


def q_fit_metrics(spark, sf):
    scored = stage(_scored(spark, sf))
    fm = M.fit_metrics(scored).join(M.exact_auc(scored), "split")
    return fm.select("split", "n", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "auc")])


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def q_sum_pool(spark, sf):
    pooled = E.sum_pool(P.training_rows(spark, sf), _vectors(spark, sf))
    return E.long_form(pooled).select("xmi", "round", "section", F.col("dim").cast("bigint").alias("dim"),
                                      (F.round("value", 5) + F.lit(0.0)).alias("value"))  # -0.0 -> 0.0


def q_embed_texts(spark, sf):
    emb = E.embed_texts(stage(P.training_rows(spark, sf)), _vectors(spark, sf))
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return emb.select("xmi", "round", "note_id", "section", "mrn", F.col("y").cast("bigint").alias("y"),
                      T.token_count(F.col("text")).cast("bigint").alias("n_tokens"),
                      (F.round(total, 4) + F.lit(0.0)).alias("feature_sum"))


def _words(spark, sf):
    return P.training_rows(spark, sf).select("xmi", "round", "section", T.ws_tokens(F.col("text")).alias("words"))


def q_cooccurrence(spark, sf):
    """M1: counts and positive mutual information of words that stand within four places of each other."""
    rows = stage(_words(spark, sf))
    names = rows.select(F.explode("words").alias("word")).distinct().select("word", F.xxhash64("word").alias("key"))
    named = V.ppmi(V.cooccurrences(rows.withColumn("tokens", V.word_keys(F.col("words")))), names)
    return named.select("word_a", "word_b", *_big("n"), F.round("value", 6).alias("ppmi"))


def q_learned_vectors(spark, sf):
    """M1: the learned vector of every word, a row per dimension."""
    rows = stage(_words(spark, sf))
    names = rows.select(F.explode("words").alias("word")).distinct().select("word", F.xxhash64("word").alias("key"))
    return V.learn_vectors(rows.withColumn("tokens", V.word_keys(F.col("words")))).join(names.hint("merge"), "key").select("word", F.posexplode("v").alias("dim", "value"))


def q_subword_counts(spark, sf):
    """M1: each text's subwords, whole and in the encoder's window (the start mark included)."""
    rows = stage(P.training_rows(spark, sf).select("xmi", "round", "section", "text"))
    whole = SW.with_subwords(rows, max_tokens=None).select("xmi", "round", "section", F.size("tokens").alias("n"))
    window = SW.with_subwords(rows).select("xmi", "round", "section", F.size("tokens").alias("n_window"), F.xxhash64("tokens").alias("ids_hash"))
    return whole.join(window, ["xmi", "round", "section"]).select("xmi", "round", "section", *_big("n", "n_window"), "ids_hash")


QUERIES.update({
    "cooccurrence": q_cooccurrence,
    "learned_vectors": q_learned_vectors,
    "subword_counts": q_subword_counts,
    "group_class_counts": q_group_class_counts,
    "group_folds": q_group_folds,
    "balanced_folds": q_balanced_folds,
    "split_assign": q_split_assign,
    "balance_gate": q_balance_gate,
    "note_truth": q_note_truth,
    "note_scores": q_note_scores,
    "split_counts": q_split_counts,
    "auc_section": q_auc_section,
    "auc_note": q_auc_note,
    "fit_metrics": q_fit_metrics,
    "sum_pool": q_sum_pool,
    "embed_texts": q_embed_texts,
})


# ---------------------------------------------------------------- training

from ..operators import train as TR  # noqa: E402
from . import training as TRN  # noqa: E402


def q_performance_table(spark, sf):
    return TRN.run_grid(spark, sf)[0]


def q_epoch_trace(spark, sf):
    perf = TRN.run_grid(spark, sf)[0]
    return perf.select("epoch", *[F.round(c, 6).alias(c) for c in ("train_auc", "val_auc", "test_auc",
                                                                  "train_auc_pa", "val_auc_pa", "test_auc_pa")])


def q_score_splits(spark, sf):
    """M3: the score of every row after every epoch of every setting."""
    return TRN.grid_scores(spark, sf)[1]


def q_train_mlp(spark, sf):
    """M2: AUC of the first setting's last epoch by split."""
    scores = TRN.grid_scores(spark, sf)[1]
    last = stage(scores.where((F.col("run") == 0) & (F.col("epoch") == TR.param_grid()[0]["epochs"] - 1)))
    return M.exact_auc(last).join(last.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n")), "split")


def q_fit_trace(spark, sf):
    """A10 after every epoch of every run, training and validation rows."""
    trace = TRN.fit_trace(TRN.grid_scores(spark, sf)[1])
    return trace.select("run", "epoch", "split", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "auc")])


def q_running_metrics(spark, sf):
    """A10 on a score that SQL can express."""
    got = M.running_metrics(stage(_scored(spark, sf)))
    return got.select("split", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "auc")])


SEARCHED = range(20, 40)


def q_split_search(spark, sf):
    """Positives in test and validation of 20 split numbers, and whether they pass."""
    folds = FO.folds_of_seeds(FO.group_class_counts(_labels(spark, sf)), SEARCHED)
    return FO.seed_gates(stage(folds)).select(F.col("random_number").cast("bigint").alias("random_number"), "pos_test", "pos_val", "passed")


def q_performance_counts(spark, sf):
    """M8's settings and twelve count columns, which don't depend on the fit."""
    return TRN.performance_counts(stage(_split_rows(spark, sf)), TR.param_grid()[0], FOLD_SEED)


def q_score_rows(spark, sf):
    """M3's rows: what is scored, in which split, with which label."""
    return TRN.gated(stage(_split_rows(spark, sf))).select("xmi", "round", "note_id", "section", "split", *_big("y"))


QUERIES.update({
    "train_mlp": q_train_mlp,
    "score_splits": q_score_splits,
    "epoch_trace": q_epoch_trace,
    "performance_table": q_performance_table,
    "fit_trace": q_fit_trace,
    "running_metrics": q_running_metrics,
    "split_search": q_split_search,
    "performance_counts": q_performance_counts,
    "score_rows": q_score_rows,
})
