"""Ranking of channels inside a group and the metrics built on the ranks.

A group is (patient, recording, sequence); names of group, node, score and
label columns are parameters.  Equal scores rank by ``node`` ascending.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from onsetry.operators.grouped import down, hot_groups, numbered, ordered, quantiles, whole_table, with_totals

GROUP = ["patient", "seizure_id", "seq_idx"]


def ratio(a, b) -> Column:
    """``a / b``, null where ``b`` is zero."""
    a = F.lit(a) if not isinstance(a, Column) else a
    return a / F.nullif(b, F.lit(0))


def top_count(frac: float, n: str = "n") -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(float(frac)) * F.col(n))).cast("long")


def rank_rows(df, group=GROUP, score="y_score", node="node_index", tie=(), name="rank", hot=None) -> DataFrame:
    """Rank by score inside the group; rows without a score are dropped."""
    scored = df.where(F.col(score).isNotNull())
    return numbered(scored, list(group), [down(score), node, *tie], name, hot)


def collapse_nodes(df, group=GROUP, score="y_score", node="node_index", label="is_soz", rank=None) -> DataFrame:
    """R2: one row per node: highest score, OR of the labels, lowest rank."""
    aggs = [F.max(score).alias(score), F.max(F.coalesce(F.col(label).cast("int"), F.lit(0))).alias(label)]
    if rank:
        aggs.append(F.min(rank).alias(rank))
    return df.groupBy(*group, node).agg(*aggs)


def top_flags(nodes, fracs=(0.1, 0.2), group=GROUP, score="y_score", node="node_index", hot=None) -> DataFrame:
    """Rank, group size, k and an in-top flag per fraction."""
    out = ordered(
        nodes.where(F.col(score).isNotNull()), list(group), [down(score), node],
        number="rank", totals={"n": F.count(F.lit(1))}, hot=hot,
    )
    for f in fracs:
        pct = round(f * 100)
        out = out.withColumn(f"k{pct}", top_count(f)).withColumn(
            f"in_top{pct}", F.col("rank") <= F.col(f"k{pct}")
        )
    return out


def group_metrics(
    nodes, group=GROUP, fracs=(0.1, 0.2), score="y_score", label="is_soz", node="node_index", tie=(),
    brier=False, hot=None,
) -> DataFrame:
    """Per group: sizes, top-fraction hits, ROC area, mean scores, first positive rank.

    Rows are reduced to distinct scores before the area is formed, so tied
    scores cost one row each.  ``hot`` may name the large groups of a table the
    nodes were reduced from: cheaper to count, and a split never changes a result.  The area is sum over positives of the negatives
    below plus half of the tied ones, over positives times negatives.
    """
    g = list(group)
    scored = nodes.where(F.col(score).isNotNull()).withColumn("_y", F.col(label).cast("int"))
    hot = hot_groups(scored, g) if hot is None else hot
    ranked = ordered(
        scored, g, [down(score), node, *tie], number="_rank", totals={"n": F.count(F.lit(1))}, hot=hot
    )
    pos = F.col("_y") == 1
    per = [
        F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_p"),
        F.min(F.when(pos, F.col("_rank"))).alias("_first"),
    ]
    for f in fracs:
        pct, inside = round(f * 100), F.col("_rank") <= top_count(f)
        per += [
            F.sum(F.when(inside, F.col("_y")).otherwise(0)).alias(f"_tp{pct}"),
            F.max(F.when(inside & pos, F.col("_rank"))).alias(f"_last{pct}"),
        ]
    if brier:
        per.append(F.sum(F.pow(F.col("_y") - F.col(score), 2)).alias("_sq"))
    by_score = ranked.groupBy(*g, score).agg(*per).withColumn("_n", F.col("_c") - F.col("_p"))
    # without large groups the rows still lie by group
    run = ordered(by_score, g, [score], running={"_neg": F.col("_n")}, hot=hot or [])
    below = F.col("_neg") - F.col("_n") / 2
    fin = [
        F.sum("_c").alias("n"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"),
        F.sum(F.col("_p") * below).alias("_u"),
        F.sum(F.col("_p") * F.col(score)).alias("_sp"), F.sum(F.col("_n") * F.col(score)).alias("_sn"),
        F.min("_first").alias("first_rank"),
    ]
    for f in fracs:
        pct = round(f * 100)
        fin += [F.sum(f"_tp{pct}").alias(f"tp{pct}"), F.max(f"_last{pct}").alias(f"last{pct}")]
    if brier:
        fin.append(F.sum("_sq").alias("sq_error"))
    out = run.groupBy(*g).agg(*fin)
    out = out.withColumns({f"k{round(f * 100)}": top_count(f) for f in fracs})
    return out.withColumns({
        "auc": ratio(F.col("_u"), F.col("n_pos") * F.col("n_neg")),
        "mean_pos": ratio(F.col("_sp"), F.col("n_pos")),
        "mean_neg": ratio(F.col("_sn"), F.col("n_neg")),
    }).withColumn("gap", F.col("mean_pos") - F.col("mean_neg")).drop("_u", "_sp", "_sn")


def topk_scores(gm: DataFrame, pct: int, fp_mode: str = "before_last") -> dict[str, Column]:
    """Precision, recall and F1 at a fraction from ``group_metrics`` rows.

    ``classic`` counts every negative in the top k; ``before_last`` only those
    above the last positive of the top k, or k if there is none.  Recall of a
    group without positives is 0.
    """
    tp, k = F.col(f"tp{pct}"), F.col(f"k{pct}")
    if fp_mode == "classic":
        fp = k - tp
    elif fp_mode == "before_last":
        fp = F.when(tp == 0, k).otherwise(F.col(f"last{pct}") - tp)
    else:
        raise ValueError("fp_mode must be 'classic' or 'before_last'")
    prec = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(ratio(tp, F.col("n_pos")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * prec * rec, prec + rec), F.lit(0.0))
    return {f"precision{pct}": prec, f"recall{pct}": rec, f"f1_{pct}": f1}


def with_topk_scores(gm: DataFrame, fracs=(0.1, 0.2), fp_mode="before_last") -> DataFrame:
    add: dict[str, Column] = {}
    for f in fracs:
        add.update(topk_scores(gm, round(f * 100), fp_mode))
    return gm.withColumns(add)


def patient_metrics(df, by=("patient",), group=GROUP, fp_mode="before_last", **cols) -> DataFrame:
    """Means over the groups of a patient, skipping undefined values."""
    keys = [*[b for b in by if b not in group], *group]
    hot = hot_groups(df, keys)  # counted on the rows before they are reduced to nodes
    gm = with_topk_scores(group_metrics(collapse_nodes(df, keys, **cols), keys, **cols, hot=hot), fp_mode=fp_mode)
    return gm.groupBy(*by).agg(*[
        F.avg(c).alias(a) for c, a in [
            ("mean_pos", "mean_score_pos"), ("mean_neg", "mean_score_neg"), ("gap", "confidence_gap"),
            ("precision10", "precision_top10"), ("recall10", "recall_top10"), ("f1_10", "f1_top10"),
            ("precision20", "precision_top20"), ("recall20", "recall_top20"), ("f1_20", "f1_top20"),
            ("auc", "auc_group_mean"),
        ]
    ], F.count(F.lit(1)).alias("num_groups_used"), F.count("auc").alias("num_auc_groups_used"))


def level_metrics(df, level: list[str], group=GROUP, node="node_index", score="y_score", label="is_soz",
                  tie=(), fracs=(0.1, 0.2)) -> DataFrame:
    """Metrics of one level (fold, patient or everything), groups weighted equally.

    Recall of a group without positives is 1 here.
    """
    keys = [*[c for c in level if c not in group], *group]
    # rows per level bound the groups per level, and are cheaper to count
    large = hot_groups(df, level) if level else whole_table(df)
    gm = group_metrics(df, keys, fracs, score, label, node, tie, brier=True)
    add: dict[str, Column] = {}
    for f in fracs:
        pct = round(f * 100)
        prec = F.col(f"tp{pct}") / F.col(f"k{pct}")
        add[f"precision_top{pct}"] = prec
        add[f"recall_top{pct}"] = F.coalesce(ratio(F.col(f"tp{pct}"), F.col("n_pos")), F.lit(1.0))
        add[f"enrichment_top{pct}"] = ratio(prec, F.col("n_pos") / F.col("n"))
    gm = gm.withColumns(add)
    aggs = {c: F.avg(c) for c in add}
    aggs |= {
        "auc_group_mean": F.avg("auc"),
        "num_groups_eval": F.count(F.lit(1)),
        "brier": F.sum("sq_error") / F.sum("n"),
        "mean_score_pos_global": ratio(F.sum(F.coalesce(F.col("mean_pos") * F.col("n_pos"), F.lit(0.0))), F.sum("n_pos")),
        "mean_score_neg_global": ratio(F.sum(F.coalesce(F.col("mean_neg") * F.col("n_neg"), F.lit(0.0))), F.sum("n_neg")),
        "gap_group_mean": F.avg("gap"),
        "gap_group_min": F.min("gap"),
        "gap_group_max": F.max("gap"),
        "gap_num_groups": F.count("gap"),
    }
    out = quantiles(gm, level, {"gap_group_median": ("gap", 0.5)}, aggs, large)
    return out.withColumn("gap_global", F.col("mean_score_pos_global") - F.col("mean_score_neg_global"))


def topk_retrieval(df, ks=(1, 3, 5, 10, 20), group=GROUP, node="node_index", score="y_score",
                   label="is_soz", tie=()) -> DataFrame:
    """R8 per group and k: gain, average precision, recall, hit, rates and chance-corrected forms."""
    g = list(group)
    scored = df.where(F.col(score).isNotNull()).withColumn("_y", F.col(label).cast("int"))
    totals = scored.groupBy(*[F.col(k).alias(f"_t_{k}") for k in g]).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n_pos"))
    # only the first max(ks) ranks carry information beyond the totals; Spark cuts each group to them before the shuffle
    order = [down(score), node, *tie]
    head = numbered(scored, g, order, "_rank", hot=[]).where(F.col("_rank") <= max(ks))
    head = head.withColumn("_hits", F.sum("_y").over(Window.partitionBy(*g).orderBy("_rank")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in g])
    head = head.join(totals, same)
    at_k = head.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("_rank <= k")
    rows = at_k.groupBy(*g, "k").agg(
        F.first("n").alias("n"), F.first("n_pos").alias("n_pos"),
        F.sum("_y").alias("tp"),
        F.sum(F.col("_y") / F.log2(F.col("_rank") + 1)).alias("dcg"),
        F.sum(F.col("_y") * F.col("_hits") / F.col("_rank")).alias("ap_sum"),
    )
    k_eff = F.least(F.col("k").cast("long"), F.col("n"))
    rows = rows.withColumns({"k_eff": k_eff, "n_neg": F.col("n") - F.col("n_pos")})
    ideal = F.expr(
        "CASE WHEN least(k, n_pos) > 0 THEN aggregate(sequence(1L, least(cast(k as bigint), n_pos)), 0D,"
        " (a, i) -> a + 1 / log2(i + 1)) END"
    )
    no_hit = F.expr(
        "aggregate(sequence(0L, k_eff - 1), 1D, (a, i) -> a * greatest(n_neg - i, 0L) / (n - i))"
    )
    rows = rows.withColumns({
        "ndcg": F.coalesce(F.col("dcg") / ideal, F.lit(0.0)),
        "map": F.col("ap_sum") / F.greatest(F.lit(1), F.col("tp")),
        "recall": F.coalesce(ratio(F.col("tp"), F.col("n_pos")), F.lit(1.0)),
        "hit": F.when(F.col("tp") > 0, 1.0).otherwise(0.0),
        "precision": F.col("tp") / F.col("k_eff"),
        "fpr": ratio(F.col("k_eff") - F.col("tp"), F.col("n_neg")),
        "_hit_exp": F.when(F.col("n_pos") > 0, 1 - no_hit).otherwise(0.0),
    })
    prec_exp = F.col("n_pos") / F.col("n")
    fpr_exp = F.when(F.col("n_neg") > 0, F.col("k_eff") / F.col("n"))
    rows = rows.withColumns({
        "specificity": 1 - F.col("fpr"),
        "hit_corrected": ratio(F.col("hit") - F.col("_hit_exp"), 1 - F.col("_hit_exp")),
        "precision_corrected": ratio(F.col("precision") - prec_exp, 1 - prec_exp),
        "fpr_corrected": ratio(F.col("fpr") - fpr_exp, 1 - fpr_exp),
    })
    return rows.withColumn("specificity_corrected", 1 - F.col("fpr_corrected")).drop(
        "dcg", "ap_sum", "_hit_exp", "k_eff"
    )


def retrieval_summary(df, **kw) -> DataFrame:
    """Mean over groups per k."""
    names = ["ndcg", "map", "recall", "hit", "precision", "fpr", "specificity", "hit_corrected",
             "precision_corrected", "fpr_corrected", "specificity_corrected"]
    return topk_retrieval(df, **kw).groupBy("k").agg(
        *[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("num_groups")
    )


def first_positive_ranks(ranked, by=("patient",), group=GROUP, label="is_soz", node="node_index",
                         recording="seizure_id", hot=None) -> DataFrame:
    """Statistics of the best positive rank over a patient's groups."""
    first = ranked.groupBy(*group).agg(
        F.min(F.when(F.col(label) == 1, F.col("rank"))).alias("_r"),
        F.count_distinct(node).alias("_nodes"),
    )
    out = quantiles(
        first, list(by), {"median_rank": ("_r", 0.5), "q25_rank": ("_r", 0.25), "q75_rank": ("_r", 0.75)},
        {
            "mean_rank": F.avg("_r"), "num_groups_with_soz": F.count("_r"),
            "num_seizures": F.count_distinct(recording), "max_electrodes": F.max("_nodes"),
        }, hot,
    )
    return out.withColumn("iqr_rank", F.col("q75_rank") - F.col("q25_rank"))


def all_positive_ranks(ranked, by=("patient",), group=GROUP, label="is_soz", node="node_index",
                       recording="seizure_id", hot=None) -> DataFrame:
    """Statistics of every positive rank, and group sizes."""
    per_group = ranked.groupBy(*group).agg(
        F.count_distinct(node).alias("_nodes"),
        F.count_distinct(F.when(F.col(label) == 1, F.col(node))).alias("_pos"),
    )
    sizes = per_group.groupBy(*by).agg(
        F.count(F.when(F.col("_pos") > 0, 1)).alias("num_groups_with_soz"),
        F.count_distinct(recording).alias("num_seizures"),
        F.max("_nodes").alias("max_electrodes"),
        F.max("_pos").alias("max_soz_electrodes"),
    )
    stats = quantiles(
        ranked.where(F.col(label) == 1), list(by),
        {"median_rank": ("rank", 0.5), "q25_rank": ("rank", 0.25), "q75_rank": ("rank", 0.75)},
        {"mean_rank": F.avg("rank")}, hot,
    ).withColumn("iqr_rank", F.col("q75_rank") - F.col("q25_rank"))
    return sizes.join(stats, list(by), "left")


def positive_ranks(ranked, group=GROUP, label="is_soz", node="node_index") -> DataFrame:
    """The rank rows of the positive channels."""
    return ranked.where(F.col(label) == 1).select(*group, node, "rank")


def mean_gap(nodes, group, by, score="y_score", label="is_soz", suffix="") -> DataFrame:
    """Mean positive score, mean negative score and gap per group, then per patient."""
    per = nodes.groupBy(*group).agg(
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("_p"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("_q"),
    )
    return per.groupBy(*by).agg(
        F.avg("_p").alias(f"mean_score_pos{suffix}"), F.avg("_q").alias(f"mean_score_neg{suffix}"),
        F.avg(F.col("_p") - F.col("_q")).alias(f"confidence_gap{suffix}"),
    )


def recording_gap(df, by=("patient",), recording=("patient", "seizure_id"), **cols) -> DataFrame:
    """Gap per recording over all channels, averaged per patient."""
    return mean_gap(collapse_nodes(df, recording, **cols), recording, by)


def top_gap(df, frac=0.1, by=("patient",), group=("patient", "seizure_id"), suffix="_top10", **cols) -> DataFrame:
    """The same inside the top fraction of each group."""
    pct = round(frac * 100)
    hot = hot_groups(df, list(group))
    top = top_flags(collapse_nodes(df, group, **cols), (frac,), group, hot=hot).where(f"in_top{pct}")
    return mean_gap(top, group, by, suffix=suffix)


def gap_range(gm: DataFrame, by=("patient",)) -> DataFrame:
    """Smallest and largest group value per patient."""
    return gm.groupBy(*by).agg(*[
        fn(c).alias(f"{p}_{a}")
        for p, fn in (("min", F.min), ("max", F.max))
        for c, a in (("mean_pos", "score_pos"), ("mean_neg", "score_neg"), ("gap", "gap"))
    ])


def pointwise_gap(df, group=GROUP, score="y_score", label="is_soz") -> DataFrame:
    """Positive minus mean negative, and mean positive minus negative, per row."""
    pos, neg = F.col(label) == 1, F.col(label) == 0
    out = with_totals(df.where(F.col(score).isNotNull()), list(group), {
        "_mp": F.avg(F.when(pos, F.col(score))), "_mn": F.avg(F.when(neg, F.col(score))),
    })
    return out.withColumns({
        "pos_score": F.when(pos, F.col(score)),
        "neg_score": F.when(neg, F.col(score)),
        "gap": F.when(pos, F.col(score) - F.col("_mn")).when(neg, F.col("_mp") - F.col(score)),
    }).drop("_mp", "_mn")


def top_scores(nodes, frac=0.1, group=GROUP, **cols) -> DataFrame:
    """Score rows inside the top fraction."""
    return top_flags(nodes, (frac,), group, **cols).where(f"in_top{round(frac * 100)}")


def recording_scores(df, recording=("patient", "seizure_id"), node="node_index", score="y_score",
                     label="is_soz") -> DataFrame:
    """Highest score of a channel over the sequences of a recording."""
    return df.groupBy(*recording, node).agg(
        F.max(score).alias(score), F.max(label).alias(label), F.count(F.lit(1)).alias("n_rows")
    )


def macro_micro(per_patient: DataFrame, value: str, weight: str) -> DataFrame:
    """Plain mean over patients and mean weighted by sequence count, nulls skipped."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return per_patient.agg(
        F.avg(value).alias("macro"), ratio(F.sum(F.col(value) * F.col(weight)), F.sum(w)).alias("micro"),
        F.count(value).alias("n_patients"),
    )


def histogram(df, value: str, by: list[str], lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per equal-width bin, nulls dropped, values clipped to the range."""
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col(value) - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def separability(long: DataFrame, by: list[str], feature="feature", value="value", label="is_soz") -> DataFrame:
    """d' = (mean1 - mean0) / sqrt((var1 + var0) / 2), population variances."""
    v1, v0 = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    pooled = F.sqrt((F.var_pop(v1) + F.var_pop(v0)) / 2)
    return long.groupBy(*by, feature).agg(
        F.avg(v1).alias("_m1"), F.avg(v0).alias("_m0"), pooled.alias("_s")
    ).select(*by, feature, ratio(F.col("_m1") - F.col("_m0"), F.col("_s")).alias("dprime"))


def top_features(dprime: DataFrame, by: list[str], n: int, feature="feature") -> DataFrame:
    """Strongest features by absolute d'; the rank filter cuts groups before the shuffle."""
    scored = dprime.where("dprime is not null")
    return numbered(scored, by, [down(F.abs("dprime")), feature], "rank", hot=[]).where(F.col("rank") <= n)
