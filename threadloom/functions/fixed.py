"""Fixed values. Results depend on every one of them being exactly as written."""

# --- fixed values: chat template ------------------------------------------
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
EOF_MARK = "> EOF by user"
ASSISTANT_MARK = "<|im_start|>assistant"
HISTORY_HEADER = "\n\nRecent conversation:\n"
CONTEXT_HEADER = "\n\nRelevant context:\n"
SERVICE_SYSTEM_TEXT = (
    "You are {name}, a helpful AI assistant. Respond in a casual, "
    "conversational tone. You can insult people when it's funny."
)
TESTER_SYSTEM_TEXT = (
    "You are a helpful assistant responding in a casual, conversational tone."
)
ECHO_FALLBACK = "what"
BLANK_MENTION_PROMPT = "Hey, what's up?"

# --- fixed values: prompt-echo phrases; {name} is the assistant's name ------
ECHO_PHRASES = [
    "you are {name}",
    "helpful ai assistant",
    "recent conversation",
    "relevant context",
    "i am a helpful assistant",
    "i am {name}",
]

# --- fixed values: mojibake repairs, applied in this order ------------------
MOJIBAKE = [
    ("â\u0080\u0099", "'"),
    ("â\u0080\u0098", "'"),
    ("â\u0080\u009c", '"'),
    ("â\u0080\u009d", '"'),
    ("â\u0080\u0094", "—"),
    ("â\u0080\u0093", "–"),
    ("â\u0080¦", "..."),
    ("donât", "don't"),
    ("theyâre", "they're"),
    ("itâs", "it's"),
    ("Iâm", "I'm"),
    ("youâre", "you're"),
    ("weâre", "we're"),
    ("theyâve", "they've"),
    ("wouldnât", "wouldn't"),
    ("couldnât", "couldn't"),
    ("shouldnât", "shouldn't"),
]

# --- fixed values: retrieval -------------------------------------------------
MESSAGE_TYPE = "discord_message"
DOCS_TYPE = "wpilib_documentation"
DOCS_SOURCE = "WPILib FRC Documentation"
DOCS_KEYWORDS = [
    "robot", "motor", "sensor", "autonomous", "teleop",
    "pid", "control", "drive", "wpiliib", "frc",
    "command", "subsystem", "encoder", "gyro",
]

# --- fixed values: message filters -------------------------------------------
ATTACHMENT_PHRASE = "sent an attachment"
REACTION_PREFIX = "Reacted "
REACTION_PHRASE = "to your message"

# --- fixed values: image commands --------------------------------------------
IMAGE_COMMAND_PATTERNS = [
    r"@Meta\s+AI\s+/imagine\s+(.+)",
    r"/imagine\s+(.+)",
]
IMAGE_COMMAND_WORDS = ["@Meta AI", "/imagine"]

# --- fixed values: limits ----------------------------------------------------
CONTEXT_FRAME = 2
HISTORY_LIMIT = 5
MEMORY_ENTRIES = 10
TRAIN_RATIO = 0.9
MESSAGE_HITS = 3
DOCS_HITS = 2
DEFAULT_HITS = 2
DEFAULT_SNIPPET = 200
FILTERED_SNIPPET = 150
MIN_SECTION_CHARS = 50
MAX_REPLY_CHARS = 2000
MAX_IMAGE_PROMPT_CHARS = 200
MAX_SLUG_CHARS = 50
