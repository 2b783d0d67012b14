"""Word lists, constants and formats that results depend on, stated as data."""

# --- file names -----------------------------------------------------------------------------
PUBLISHER = "Edika"
THIRD_CORPUS_TITLE = "CTDC"
CLASS_MARKERS = ("a1", "b1")  # name contains the marker -> class 0, 1; first match wins
THIRD_CLASS_CAP = 230
THIRD_CLASS_FIRST_GROUP = 31
THIRD_CLASS_GROUPS = 10
SEED = 42

# --- tokens ---------------------------------------------------------------------------------
PAGE_BREAK = "\x0c"
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*|[.!?]+"
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
SENTENCE_END_MARKS = (".", "?", "!")
DIALOGUE_MARKS = ("„", '"', "“")

# --- syllables ------------------------------------------------------------------------------
VOWELS = "aeiuoyáéíóúůýěäëïöü"
SYLLABIC_M_WORDS = ("sedm", "osm", "vosm", "hm")  # whose final m makes a syllable

# --- readability formulas, constants for Czech -------------------------------------------------
FLESCH_EASE = (206.935, 1.672, 62.183)
FLESCH_KINCAID = (0.52, 9.133, 16.393)
AUTO_READ_INDEX = (3.666, 0.631, 19.491)
COLEMAN_LIAU = (0.047, 0.286, 12.9)

# --- frequency dictionary -----------------------------------------------------------------------
FREQUENCY_COLUMNS = ("rank", "form", "freq", "recalc_freq", "fict_freq", "branch_freq", "journal_freq", "freq_char")

# --- feature file: header of the CSV layout -> our column, in file order --------------------------
# The two rank columns hold a maximum, so they are headed max_* here.
FEATURE_HEADERS = {
    "words/sent": "words_per_sentence",
    "mean_chars/wd": "mean_chars_per_word",
    "max_chars/wd": "max_chars_per_word",
    "punct/sent": "punct_per_sentence",
    "punct_tr": "punct_token_ratio",
    "non_sent_end_punct": "non_sentence_end_punct",
    "dialog_punct_tr": "dialogue_punct_ratio",
    "ttr": "type_token_ratio",
    "pro_tr": "pronoun_ratio",
    "1sing_pro_tr": "pronoun_1sg_ratio",
    "3sing_pro_tr": "pronoun_3sg_ratio",
    "1pl_pro_tr": "pronoun_1pl_ratio",
    "2pl_pro_tr": "pronoun_2pl_ratio",
    "3pl_pro_tr": "pronoun_3pl_ratio",
    "Verbs/sent": "verbs_per_sentence",
    "aux/sent": "aux_per_sentence",
    "ind_vbs/sent": "indicatives_per_sentence",
    "cond_vbs/sent": "conditionals_per_sentence",
    "Verbs_tr": "verb_token_ratio",
    "word_length": "word_length",
    "nouns/sent": "nouns_per_sentence",
    "adjs/sent": "adjectives_per_sentence",
    "adps/sent": "adpositions_per_sentence",
    "mean_lemma_freq": "mean_lemma_freq",
    "min_lemma_freq": "min_lemma_freq",
    "mean_lemma_rank": "mean_lemma_rank",
    "max_lemma_rank": "max_lemma_rank",
    "mean_word_freq": "mean_word_freq",
    "min_word_freq": "min_word_freq",
    "mean_word_rank": "mean_word_rank",
    "max_word_rank": "max_word_rank",
    "mean_dep_len": "mean_dep_length",
    "min_dep_len": "min_dep_length",
    "max_dep_len": "max_dep_length",
    "mean_dep_len_nouns": "mean_dep_length_noun",
    "max_dep_len_nouns": "max_dep_length_noun",
    "mean_dep_len_adjs": "mean_dep_length_adj",
    "max_dep_len_adjs": "max_dep_length_adj",
    "mean_dep_len_advs": "mean_dep_length_adv",
    "max_dep_len_advs": "max_dep_length_adv",
    "mean_dep_len_vbs": "mean_dep_length_verb",
    "max_dep_len_vbs": "max_dep_length_verb",
    "mean_dep_len_intjs": "mean_dep_length_intj",
    "max_dep_len_intjs": "max_dep_length_intj",
}

# --- rule annotator: closed-class forms (language, part of speech, features, forms) ----------------
LEXICON = (
    ("en", "PRON", "Number=Sing|Person=1|PronType=Prs", "i me"),
    ("en", "PRON", "Number=Sing|Person=2|PronType=Prs", "thou thee"),
    ("en", "PRON", "Number=Sing|Person=3|PronType=Prs", "he him she her it"),
    ("en", "PRON", "Number=Plur|Person=1|PronType=Prs", "we us"),
    ("en", "PRON", "Number=Plur|Person=2|PronType=Prs", "you ye"),
    ("en", "PRON", "Number=Plur|Person=3|PronType=Prs", "they them"),
    ("en", "PRON", "PronType=Dem", "this that"),
    ("en", "AUX", "Mood=Ind", "is are was were am has have had do does did will can"),
    ("en", "AUX", "Mood=Cnd", "would could should"),
    ("en", "AUX", "", "be been being"),
    ("en", "ADP", "", "of in on at by with from to for into"),
    ("en", "DET", "", "the a an"),
    ("en", "CCONJ", "", "and or but"),
    ("en", "ADV", "", "not here there now then"),
    ("en", "INTJ", "", "oh ah hey ha haha"),
    ("fr", "PRON", "Number=Sing|Person=1|PronType=Prs", "je moi"),
    ("fr", "PRON", "Number=Sing|Person=2|PronType=Prs", "tu toi"),
    ("fr", "PRON", "Number=Sing|Person=3|PronType=Prs", "il elle on"),
    ("fr", "PRON", "Number=Plur|Person=1|PronType=Prs", "nous"),
    ("fr", "PRON", "Number=Plur|Person=2|PronType=Prs", "vous"),
    ("fr", "PRON", "Number=Plur|Person=3|PronType=Prs", "ils elles"),
    ("fr", "PRON", "PronType=Rel", "que qui"),
    ("fr", "AUX", "Mood=Ind", "est sont avait ai ont"),
    ("fr", "AUX", "Mood=Cnd", "serait aurait"),
    ("fr", "ADP", "", "de à en dans par pour avec sur"),
    ("fr", "DET", "", "le la les un une des du"),
    ("fr", "CCONJ", "", "et ou mais"),
    ("fr", "ADV", "", "ne pas"),
    ("fr", "INTJ", "", "oh ah"),
    ("de", "PRON", "Number=Sing|Person=1|PronType=Prs", "ich mich"),
    ("de", "PRON", "Number=Sing|Person=2|PronType=Prs", "du dich"),
    ("de", "PRON", "Number=Sing|Person=3|PronType=Prs", "er sie es"),
    ("de", "PRON", "Number=Plur|Person=1|PronType=Prs", "wir uns"),
    ("de", "PRON", "Number=Plur|Person=2|PronType=Prs", "ihr euch"),
    ("de", "PRON", "Number=Plur|Person=3|PronType=Prs", "ihnen"),
    ("de", "AUX", "Mood=Ind", "ist sind war hat haben wird"),
    ("de", "AUX", "Mood=Cnd", "würde wäre"),
    ("de", "ADP", "", "in von mit auf zu bei aus an"),
    ("de", "DET", "", "der die das ein eine den dem des"),
    ("de", "CCONJ", "", "und oder aber"),
    ("de", "ADV", "", "nicht auch"),
    ("de", "INTJ", "", "ach oh"),
    ("es", "PRON", "Number=Sing|Person=1|PronType=Prs", "yo me"),
    ("es", "PRON", "Number=Sing|Person=2|PronType=Prs", "tú te"),
    ("es", "PRON", "Number=Sing|Person=3|PronType=Prs", "él ella"),
    ("es", "PRON", "Number=Plur|Person=1|PronType=Prs", "nosotros nos"),
    ("es", "PRON", "Number=Plur|Person=2|PronType=Prs", "vosotros os"),
    ("es", "PRON", "Number=Plur|Person=3|PronType=Prs", "ellos ellas"),
    ("es", "AUX", "Mood=Ind", "es son era ha han está"),
    ("es", "AUX", "Mood=Cnd", "sería habría"),
    ("es", "ADP", "", "de en con por para a"),
    ("es", "DET", "", "el la los las un una"),
    ("es", "CCONJ", "", "y o pero"),
    ("es", "ADV", "", "no ya"),
    ("es", "INTJ", "", "ay oh"),
    ("cs", "PRON", "Number=Sing|Person=1|PronType=Prs", "já mě"),
    ("cs", "PRON", "Number=Sing|Person=2|PronType=Prs", "ty tě"),
    ("cs", "PRON", "Number=Sing|Person=3|PronType=Prs", "on ona ono"),
    ("cs", "PRON", "Number=Plur|Person=1|PronType=Prs", "my nás"),
    ("cs", "PRON", "Number=Plur|Person=2|PronType=Prs", "vy vás"),
    ("cs", "PRON", "Number=Plur|Person=3|PronType=Prs", "oni"),
    ("cs", "AUX", "Mood=Ind", "jsem jsi je jsme jste jsou"),
    ("cs", "AUX", "Mood=Cnd", "bych bys by bychom byste"),
    ("cs", "AUX", "", "být byl byla bylo byli"),
    ("cs", "ADP", "", "v na s z do k o po za"),
    ("cs", "CCONJ", "", "a ale nebo"),
    ("cs", "INTJ", "", "ach"),
)

# --- rule annotator: open-class endings (language, ending, part of speech, features) ---------------
# The first matching ending of a language decides; the word must be at least two letters longer.
ENDINGS = (
    ("en", "ing", "VERB", ""),
    ("en", "ed", "VERB", "Mood=Ind"),
    ("en", "es", "VERB", "Mood=Ind"),
    ("en", "ly", "ADV", ""),
    ("en", "ble", "ADJ", ""),
    ("en", "st", "ADJ", ""),
    ("fr", "ier", "VERB", ""),
    ("fr", "ait", "VERB", "Mood=Ind"),
    ("fr", "ons", "VERB", "Mood=Ind"),
    ("fr", "ment", "ADV", ""),
    ("fr", "eux", "ADJ", ""),
    ("de", "en", "VERB", ""),
    ("de", "te", "VERB", "Mood=Ind"),
    ("de", "lich", "ADJ", ""),
    ("de", "ig", "ADJ", ""),
    ("de", "weise", "ADV", ""),
    ("es", "ar", "VERB", ""),
    ("es", "aba", "VERB", "Mood=Ind"),
    ("es", "mente", "ADV", ""),
    ("es", "oso", "ADJ", ""),
    ("cs", "at", "VERB", ""),
    ("cs", "al", "VERB", "Mood=Ind"),
    ("cs", "ě", "ADV", ""),
    ("cs", "ý", "ADJ", ""),
)
