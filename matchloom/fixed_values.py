"""Fixed values.

Everything in this file is a constant whose exact value decides the result: vocabularies, patterns,
thresholds, message and prompt formats. They are kept together and in plain text on purpose.
"""

# Character classes, written out so that Java and RE2 agree with Unicode-aware \s and \w.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"

# ---------------------------------------------------------------- sections
SECTION_TITLES = [
    "employment",
    "education",
    "experience",
    "projects",
    "skills",
    "coursework",
    "research",
    "achievements",
    "technologies",
    "description",
    "responsibilities",
    "requirements",
    "objective",
    "summary",
    "certifications",
]
CONNECTORS = ["and", "of", "the", "a", "an"]
MAX_TITLE_WORDS = 3
RESUME_SECTIONS = ["experience", "projects", "skills"]
JOB_SECTIONS = ["responsibilities", "requirements", "description"]

# ---------------------------------------------------------------- contact patterns (case-insensitive)
EMAIL = (
    rf"(?i)(?:(?:[{WORD}-]+(?:\.[{WORD}-]+)*)@(?:(?:[{WORD}-]+\.)*[{WORD}][{WORD}-]{{0,66}})"
    r"\.(?:[a-z]{2,6}(?:\.[a-z]{2})?))"
)
PHONE = rf"(?i)(?:\(?[0-9]{{3}}\)?[-.{SPACE}]?[0-9]{{3}}[-.{SPACE}]?[0-9]{{4}})"
GPA = rf"(?i)(?:GPA|gpa)[:{SPACE}]*([1-4](?:\.[0-9]{{1,2}})?(?:/4\.0?|/4)?)"
LINKEDIN = rf"(?i)(?:linkedin\.com/in/[{WORD}-]+|linkedin\.com/profile/view\?id=[{WORD}-]+)"
GITHUB = rf"(?i)(?:github\.com/[{WORD}-]+)"
# $-_ is a range on purpose: it holds the percent sign and all digits, so one class says it all and a long
# link needs no recursion.
URL = r"(?i)http[s]?://[a-zA-Z0-9$-_@.&+!*\\(\\),]+"

# ---------------------------------------------------------------- years and education
YEARS_PATTERNS = [
    rf"([0-9]+)\+?[{SPACE}]*years?[{SPACE}]*(?:of[{SPACE}]*)?experience",
    rf"([0-9]+)\+?[{SPACE}]*yrs?[{SPACE}]*(?:of[{SPACE}]*)?experience",
    rf"experience[{SPACE}]*(?:of[{SPACE}]*)?([0-9]+)\+?[{SPACE}]*years?",
    rf"([0-9]+)\+?[{SPACE}]*years?[{SPACE}]*in[{SPACE}]*[{WORD}]+",
]
EDUCATION_LEVELS = {
    "phd": ["phd", "ph.d", "doctorate", "doctoral"],
    "masters": ["masters", "master", "m.s", "mba", "ma", "ms"],
    "bachelors": ["bachelors", "bachelor", "b.s", "ba", "bs", "b.a"],
    "associates": ["associates", "associate", "aa", "as"],
    "high_school": ["high school", "diploma", "ged"],
}

# ---------------------------------------------------------------- pages and postings
MIN_SPACE_RATIO = 0.08
DEFAULT_TOLERANCE = 3
DROPPED_TAGS = ["script", "style", "noscript", "nav", "header", "footer", "form", "svg"]
ROOT_TAGS = ["main", "article"]
# How a page parser mends pages. Elements without an end tag; elements that may stand in a head; what a start tag ends
# if it is the innermost open element; and how far an end tag reaches: it closes no element of a higher number (others: 100).
VOID_TAGS = ["area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
HEAD_TAGS = ["html", "head", "title", "base", "meta", "link", "script", "style", "noscript"]
RAW_TAGS = ["script", "style"]
_BLOCK_STARTS = ["address", "article", "aside", "blockquote", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3",
                 "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"]
IMPLIED_ENDS = {
    **{t: ["p"] for t in _BLOCK_STARTS},
    "li": ["li", "p"], "dt": ["dt", "dd", "p"], "dd": ["dt", "dd", "p"], "option": ["option"], "optgroup": ["option", "optgroup"],
    "td": ["td", "th", "p"], "th": ["td", "th", "p"], "tr": ["td", "th", "tr", "p"],
    **{t: ["td", "th", "tr", "thead", "tbody", "tfoot", "p"] for t in ("thead", "tbody", "tfoot")},
}
END_REACH = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190}
MIN_POSTING_CHARS = 200
URL_SCHEME = r"(?i)^https?://"
MAX_CHUNK_CHARS = 120
UNKNOWN_CATEGORY = "Unknown"

MSG_BAD_URL = "Enter a full URL starting with http:// or https://"
MSG_SHORT_POSTING = (
    "That link didn't return the full description (it may need a login or "
    "load its content with JavaScript). Paste the text instead."
)
MSG_NO_POSTING = "Add a job link or paste the description first."

# ---------------------------------------------------------------- roles
ROLES = [
    ("Full Stack Developer", "pdfs/full-stack.pdf"),
    ("Front End Developer", "pdfs/front-end.pdf"),
    ("Product Manager", "pdfs/product-manager.pdf"),
    ("Java Developer", "pdfs/java.pdf"),
]

# ---------------------------------------------------------------- top-k sizes
RETRIEVE_K = 5
OVERFETCH = 4
FIT_K = 6
SCREEN_K = 8
METRICS_K = 3
TOP_CATEGORIES = 5

# ---------------------------------------------------------------- classifier
RANDOM_STATE = 2024
TEST_SHARE = 0.2
CALIBRATION_FOLDS = 3
MAX_FEATURES = 30000

# Spark ML's default English stop words.
ENGLISH_STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can can't cannot could couldn't did didn't do does doesn't doing don don't
down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it
it's its itself just let's me more most mustn't my myself no nor not now of off on once only or
other ought our ours ourselves out over own s same shan't she she'd she'll she's should shouldn't so
some such t than that that's the their theirs them themselves then there there's these they they'd
they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're
we've were weren't what what's when when's where where's which while who who's whom why why's will
with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()

# ---------------------------------------------------------------- score reply
SCORE = r"SCORE:[" + SPACE + r"]*([0-9]{1,3})"
BANDS = [(70, "Strong match"), (45, "Moderate match"), (None, "Weak match")]

# ---------------------------------------------------------------- prompt formats
SCREEN_JOB_CHARS = 6000
SCREEN_RESUME_CHARS = 5000
TAILOR_RESUME_CHARS = 5500
FIT_RESUME_CHARS = 4000
NO_EVIDENCE = "(none retrieved)"

# Headings of the prompts' parts.
HEAD_JOB = "JOB POSTING:\n"
HEAD_EVIDENCE = "\n\nREQUIREMENTS THIS RESUME LOOKS CLOSE TO (retrieved):\n"
HEAD_RESUME = "\n\nRESUME:\n"
HEAD_CURRENT_RESUME = "\n\nCURRENT RESUME:\n"
HEAD_ROLE = "ROLE: "
HEAD_REQUIREMENTS = "\n\nRETRIEVED JOB REQUIREMENTS:\n"

SCREEN_SYSTEM = (
    "You are a technical recruiter and the ATS that screens resumes before a human "
    "sees them. Score how well a resume matches a specific job posting, using ONLY "
    "the posting and resume provided. Judge on keyword and skill match, coverage of "
    "the required qualifications, relevant titles, and quantified impact. Cite real "
    "evidence from the resume, never invent it; a requirement with no support is a gap.\n\n"
    "Ignore graduation date, class year, and internship timing or availability "
    "completely. Never raise them as a gap, a concern, or a Missing item, and never "
    "let them affect the score.\n\n"
    "Write like a person: plain, direct, specific. Short sentences, no filler, no "
    "flattery, no hedging. Plain punctuation, no em or en dashes."
)
SCREEN_TASK = (
    "Reply in GitHub-flavored markdown. Be concise, no preamble. Use these parts:\n"
    "First line, nothing else: `SCORE: <0-100>` (recruiter/ATS match to THIS posting).\n"
    "**Verdict** - one plain sentence: does it pass the screen, and why.\n"
    "**Matched** - 3-4 one-line bullets: requirement, then the resume evidence for it.\n"
    "**Missing** - 3-4 one-line bullets: required skills or keywords the resume lacks.\n"
    "**Fix first** - 2-3 ranked, concrete edits (keywords to add only if true, bullets "
    "to reword). Never suggest fabricating experience."
)
TAILOR_SYSTEM = (
    "You tailor a candidate's existing resume to a specific job posting by making the "
    "SMALLEST changes that improve the match. Keep as much of the original as possible: "
    "preserve its structure, section order, wording, and every fact verbatim, and only "
    "touch a line when changing it clearly helps this posting. Edit by rewording an "
    "existing bullet to mirror the posting's language, or by adding a keyword the resume "
    "already supports. Do not rewrite lines that are already fine, do not drop content, "
    "and do not restructure.\n\n"
    "Never invent or exaggerate anything: no new experience, employers, titles, dates, "
    "metrics, degrees, or skills, and no new numbers. If the posting wants something the "
    "resume does not clearly support, leave it out of the resume and list it separately "
    "for the candidate to add only if it is true.\n\n"
    "Plain punctuation, no em or en dashes."
)
TAILOR_TASK = (
    "Reply in GitHub-flavored markdown with these parts:\n"
    "**Tailored resume** - the FULL resume, kept as close to the original as possible. "
    "Reproduce every section and line unchanged except the few you reword or where you "
    "add a keyword the resume already supports. Keep all facts and numbers exactly.\n"
    "**What changed** - a short bulleted list of each edit you made and why it fits the "
    "posting. If you changed nothing, say so.\n"
    "**Add only if true** - keywords or details the posting wants that the resume does "
    "not support. The candidate adds these only if accurate. Never fabricate."
)
FIT_SYSTEM = (
    "You are a technical recruiter. Judge how well the candidate fits the role "
    "using ONLY the provided job requirements and resume text. Cite specific "
    "evidence from the resume. If a requirement has no supporting evidence, list "
    "it as a gap. Never invent experience the resume does not show. Be concise."
)
FIT_TASK = (
    "Respond with:\n"
    "1. A one-sentence fit verdict.\n"
    "2. 'Strengths' — 3-5 bullets, each an actual requirement matched to resume evidence.\n"
    "3. 'Gaps' — 2-3 bullets of requirements the resume does not support."
)

# ---------------------------------------------------------------- reply states and their messages
STATUS_OK = "ok"
STATUS_NO_KEY = "no_key"
STATUS_REJECTED = "rejected"
STATUS_RATE_LIMITED = "rate_limited"
STATUS_FAILED = "failed"

MSG_SCREEN_NO_KEY = (
    "Set ANTHROPIC_API_KEY to get the scored screen and tailored feedback. "
    "Until then, here are the posting requirements your resume is closest to."
)
MSG_REJECTED = "That ANTHROPIC_API_KEY was rejected. Check the key and try again."
MSG_SCREEN_FAILED = "The screen failed after several retries: "
MSG_TAILOR_NO_KEY = "Set ANTHROPIC_API_KEY to generate a tailored rewrite of your resume."
MSG_TAILOR_FAILED = "The tailoring failed after several retries: "
MSG_FIT_NO_PASSAGES = "No indexed job requirements found for "
MSG_FIT_NO_KEY = (
    "⚠️ No Anthropic API key found. Set ANTHROPIC_API_KEY to enable AI fit "
    "analysis (retrieval still works without it)."
)
MSG_FIT_REJECTED = (
    "⚠️ No valid Anthropic API key found. Set ANTHROPIC_API_KEY to enable "
    "AI fit analysis (retrieval still works without it)."
)
MSG_FIT_RATE_LIMITED = "⚠️ Rate limited by the Anthropic API — please retry in a moment."
MSG_FIT_FAILED = "⚠️ AI fit analysis failed: "

# ---------------------------------------------------------------- metrics record
METRICS_DEFAULTS = {
    "n_resumes": 0,
    "n_categories": "?",
    "holdout_top1_accuracy": 0,
    "holdout_top3_accuracy": 0,
    "holdout_macro_f1": 0,
    "trained_at": "",
}

# ---------------------------------------------------------------- spellings of a missing value in labelled CSV files
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
