"""Fixed values that must equal the reference's for the results to agree.

Fixed values (kept together; the tags are grouped by meaning):

* section titles, tried in this order for the third section:
  "plan and assessment", "assessment and plan", "assessment"
* the two other section titles: "subjective", "objective"
* annotation tag vocabulary (11):
  SE_physio, SE_psych, SE_other, SE_physio_N, SE_psych_N, SE_other_N,
  BN_social, BN_personal, BN_other, BN_academic, _community
* side-effect tags used for labels: the first six above
* present tags: SE_physio, SE_psych, SE_other; absent tags: SE_physio_N, SE_psych_N, SE_other_N
* offset between annotation positions and note-body positions: 69
* encoder token cap: 512; minimum tokens per training text: 4; folds: 5
* hyper-parameter grid: lr 0.001, batch 32, epochs 50, width 128, dropout 0.1; seed 0, split number 22
  (the model type names the encoder that is used here, "token_vectors")
* Adam: beta_1 0.9, beta_2 0.999, epsilon 1e-8; decision threshold 0.5, thresholds of the running AUC: 200
* output columns of the performance table: PERFORMANCE_COLUMNS
"""

SUBJECTIVE = "subjective"
OBJECTIVE = "objective"
ASSESSMENT_TITLES = ("plan and assessment", "assessment and plan", "assessment")
SECTION_NAMES = ("subjective", "objective", "assessment")

#: A list of titles that contain, touch and overlap each other, some of them frequent in the given notes.
TITLES = ("subjective", "objective", "assessment", "plan", "assessment and plan", "plan and assessment", "and plan", "and assessment", "the", "of the", "in the", "and the", "tion", "ing", "ment",
          "que", "les", "des", "pour", "dans", "und", "der", "die", "sch", "ung", "keit", "history", "allergies", "medications", "s")
TAKEN = ("subjective", "assessment and plan", "plan", "of the", "tion", "ing", "que", "und", "der", "s", "not in the list")

TAG_VOCAB = (
    "SE_physio", "SE_psych", "SE_other", "SE_physio_N", "SE_psych_N", "SE_other_N",
    "BN_social", "BN_personal", "BN_other", "BN_academic", "_community",
)
SE_TAGS = ("SE_physio", "SE_psych", "SE_other", "SE_physio_N", "SE_psych_N", "SE_other_N")
SE_PRESENT = ("SE_physio", "SE_psych", "SE_other")
SE_ABSENT = ("SE_physio_N", "SE_psych_N", "SE_other_N")

SPAN_OFFSET = 69
MAX_TOKENS = 512
MIN_TOKENS = 4
N_FOLDS = 5

PARAM_GRID = {
    "lr": [0.001],
    "batch_size": [32],
    "epochs": [50],
    "dense_node": [128],
    "do": [0.1],
    "model_type": ["token_vectors"],
}
ADAM = {"beta_1": 0.9, "beta_2": 0.999, "epsilon": 1e-08}
N_THRESHOLDS = 200
SEEDS = [0]
SPLIT_NUMBERS = [22]

PERFORMANCE_COLUMNS = (
    "model_type", "lr", "batch_size", "dense_node", "seed", "random_number", "epoch", "do",
    "train_auc", "val_auc", "test_auc", "train_auc_pa", "val_auc_pa", "test_auc_pa",
    "n_train", "n_val", "n_test", "n_train_pa", "n_val_pa", "n_test_pa",
    "n_case_train", "n_case_val", "n_case_test", "n_case_train_pa", "n_case_val_pa", "n_case_test_pa",
)

# Default stop-word list: Spark ML's English list (StopWordsRemover.loadDefaultStopWords("english")),
# written out so that the DuckDB oracle can use the same literal.  A test checks it against Spark.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
)
