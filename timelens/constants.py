"""Word lists, phrases, tags, thresholds and names that results depend on."""

# --- cohort and windows (fixed values) ---
MIN_POSTS = 10
WINDOW_UNITS = 4
UNIT_DAYS = 7
WINDOWS = ["baseline", "pre_4w", "pre_2w", "pre_1w"]
PRE_WINDOWS = {"pre_4w": 4, "pre_2w": 2, "pre_1w": 1}
LABELS = ["crisis", "recovery", "neither"]
DELETED_MARKERS = ["[deleted]", "[removed]"]

# --- turning-point phrases (fixed values) ---
CRISIS_PHRASES = [
    "want to die", "wanting to die", "ending it", "end it all", "can't do this", "cant do this",
    "goodbye", "no point", "kill myself", "killing myself", "take my own life", "not worth living",
]
RECOVERY_PHRASES = [
    "got help", "getting help", "starting therapy", "started therapy", "feeling better",
    "things are improving", "made it", "on the road to recovery", "doing better", "finally better",
]
AMBIGUOUS_PHRASES = ["made it"]

# --- word lists (fixed values) ---
FIRST_PERSON = ["i", "me", "my", "mine", "myself"]
WE_WORDS = ["we", "us", "our", "ours", "ourselves"]
YOU_WORDS = ["you", "your", "yours", "yourself", "yourselves"]
NEGATIVE_WORDS = [
    "sad", "sadness", "unhappy", "miserable", "depressed", "depression",
    "hopeless", "hopelessness", "despair", "despairing", "grief", "grieve",
    "grieving", "cry", "crying", "tears", "weep", "weeping", "heartbroken",
    "devastated", "devastation", "empty", "numb", "alone", "lonely",
    "loneliness", "isolated", "isolation", "worthless", "worthlessness",
    "anxious", "anxiety", "worried", "worry", "worrying", "fear", "scared",
    "terrified", "terror", "panic", "panicking", "dread", "dreading",
    "nervous", "overwhelmed", "overwhelming", "stress", "stressed", "stressful",
    "angry", "anger", "furious", "fury", "rage", "raging", "hate",
    "hatred", "hating", "resentment", "resentful", "bitter", "bitterness",
    "frustrated", "frustration",
    "horrible", "terrible", "awful", "dreadful", "disgusting", "disgusted",
    "ashamed", "shame", "guilt", "guilty", "regret", "regretful",
    "broken", "shattered", "suffering", "suffer", "pain", "hurt",
    "hurting", "misery", "agony", "agonizing", "exhausted", "exhaustion",
    "burned out", "burnout", "lost", "confused", "confusion",
    "nauseous", "sick", "dying",
]

# --- tag groups (fixed values) ---
CRISIS_TAGS = ["suicidewatch", "suicidal", "suicidal thoughts", "want to die", "active self harm"]
RECOVERY_TAGS = [
    "mentalillnessrecovery", "mental health recovery", "depression recovery", "anxiety recovery",
    "selfharm recovery", "self harm recovery", "healing journey", "in recovery",
]
CONTROL_TAGS = [
    "photography", "books", "art", "travel", "cooking", "gaming", "movies", "music", "nature",
]
LABEL_PRIORITY = {"crisis": 0, "recovery": 1, "neither": 2}

VERIFY_MIN_POSTS = 5
VERIFY_MAX_POSTS = 100
VERIFY_MIN_MARGIN = 0.02
VERIFY_TEMPERATURE = 0.1

# --- change points and weekly sequence (fixed values) ---
CP_PENALTY = 1.5
CP_MIN_WEEKS = 6
CP_MIN_SEGMENT = 2
CP_JUMP = 5
SEQUENCE_WEEKS = 40

# --- feature names (fixed values) ---
LINGUISTIC = ["sentiment_mean", "ttr", "avg_sent_len", "post_freq", "fp_pronoun_rate",
              "neg_affect_rate", "avg_post_len"]
TEMPORAL = ["hour_entropy", "late_night_rate", "interval_mean_hr", "interval_std_hr", "max_gap_hr",
            "weekend_rate"]
STYLE = ["flesch_reading_ease", "flesch_kincaid_grade", "exclaim_rate", "question_rate",
         "ellipsis_rate", "caps_word_rate", "i_vs_we_ratio", "i_vs_you_ratio"]
METADATA = ["author", "label", "low_confidence", "n_posts", "tp_date", "n_baseline_buckets"]
SEED = 42
FOLDS = 5

# --- match-ranking names and options (fixed values) ---
INSURANCE_OPTIONS = ["medicaid", "medicare", "bcbs", "cigna", "aetna", "uhc", "uninsured", "sliding_scale"]
AGE_OPTIONS = ["child", "teen", "adult", "senior"]
URGENCY_OPTIONS = ["crisis", "urgent", "routine", "exploring"]
ENGAGEMENT_WEIGHTS = {"view": 0.3, "call": 1.0, "website": 0.6}
ENGAGEMENT_DEFAULT = 0.3
PROVIDER_FLAGS = ["is_cmhc", "is_fqhc", "is_crisis_center", "accepts_medicaid", "accepts_uninsured",
                  "has_telehealth", "has_crisis", "evening_hours", "walk_in"]
PROVIDER_PATTERNS = {
    "is_cmhc": r"Community Mental Health",
    "is_fqhc": r"Federally Qualified",
    "is_crisis_center": r"Crisis Center",
    "accepts_medicaid": r"'medicaid'",
    "accepts_uninsured": r"'uninsured'",
    "has_telehealth": r"telehealth:\s*true",
    "has_crisis": r"crisisServices:\s*true",
    "evening_hours": r"'evening'",
    "walk_in": r"'walk_in'",
}
BASE_FEATURES = [
    "insurance_match", "insurance_partial", "age_match", "concerns_overlap", "telehealth_match",
    "crisis_match", "language_match", "gender_match", "modality_overlap", "cultural_overlap",
    "is_cmhc", "is_fqhc", "is_crisis_center", "accepts_medicaid", "accepts_uninsured",
    "has_telehealth", "has_crisis_services", "urgency_is_crisis", "urgency_is_urgent",
    "user_uninsured", "evening_hours", "walk_in",
]
CROSSES = [
    ("insurance_match", "concerns_overlap", "ins_x_concerns"),
    ("insurance_match", "age_match", "ins_x_age"),
    ("crisis_match", "has_crisis_services", "crisis_x_services"),
    ("telehealth_match", "has_telehealth", "tele_x_available"),
    ("concerns_overlap", "modality_overlap", "concerns_x_modality"),
    ("urgency_is_crisis", "is_crisis_center", "urgent_x_crisis_center"),
    ("accepts_medicaid", "user_uninsured", "medicaid_x_uninsured"),
    ("cultural_overlap", "language_match", "cultural_x_language"),
]
MATCH_FEATURES = BASE_FEATURES + [name for _, _, name in CROSSES]
SUBGROUPS = {
    "insurance": {"medicaid": ["medicaid"], "private": ["bcbs", "cigna", "aetna", "uhc"],
                  "uninsured": ["uninsured", "sliding_scale"]},
    "age_group": {"child": ["child"], "teen": ["teen"], "adult": ["adult"], "senior": ["senior"]},
    "urgency": {"crisis": ["crisis"], "urgent": ["urgent"], "routine": ["routine"],
                "exploring": ["exploring"]},
}
DISPARITY_LIMIT = 0.15
