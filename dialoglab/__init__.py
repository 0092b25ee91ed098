"""dialoglab: DataFrame operators for annotated-dialogue corpora on Spark.

Modules:
    functions  column functions (vocabulary, text, labels)
    sources    readers and writers
    operators  table operators (annotators, stats, sampling, prompts, scoring, evaluation, joins, phrases)
    plans      exact ranks / running sums, fixture views, the query catalog and its DuckDB oracle
    streaming  incremental evaluation of arriving answers
"""

from .functions.labels import (
    binarize_label,
    canonicalize_labels,
    filter_measured,
    multi_hot,
    multi_hot_checked,
    parse_label_list,
    parse_yes_no,
    resolve_label_column,
    split_labels,
    threshold_scores,
    top_emotion,
)
from .functions.text import count_tokens, normalize_speakers, parse_turns, strip_speakers, truncate_tokens
from .operators.annotators import annotator_agreement, gold_labels, unpivot_annotators, vote_labels
from .operators.evaluation import (
    binary_metrics,
    confusion_binary,
    confusion_multilabel,
    leaderboard,
    multilabel_metrics,
    per_label_metrics,
    pooled_auc,
    response_quality,
)
from .operators.joins import join_predictions, unanswered, unanswered_ids
from .operators.neighbours import neighbour_graph, project_neighbours
from .operators.phrases import match_key_phrases
from .operators.prompts import (
    attach_examples,
    classifier_table,
    fewshot_messages,
    sft_text,
    sft_text_multilabel,
    zeroshot_messages,
)
from .operators.sampling import balance_classes, holdout, sample_cap, sample_per_group, select_examples, split_exact
from .operators.scoring import batch_score, best_run, project_2d, standardize, train_binary, train_multilabel
from .operators.stats import (
    ccdf,
    compare_datasets,
    dataset_summary,
    emotion_counts,
    emotion_distribution,
    emotion_distribution_wide,
    label_cooccurrence,
    label_counts,
    label_cross_cooccurrence,
    split_label_share,
    token_stats,
    turn_stats,
)
from .sources.readers import (
    assemble_dialogues,
    read_annotations,
    read_labelled_csv,
    read_text_column_csv,
    read_thread_jsonl,
    read_turn_table,
    union_corpora,
)
from .sources.writers import write_results

__all__ = [name for name in dir() if not name.startswith("_")]
