"""Fixed values shared by every operator.

These numbers and word lists define the results, so they are stated here once, plainly.
"""

# --- readings -----------------------------------------------------------------------------
RELIABLE_SCORE = 0.6
OK, INTERPOLATED, NO_FIX, SPOOFED, UNREADABLE = (
    "ok", "interpolated", "no_fix", "spoofed", "unreadable",
)
ALL_STATUSES = (OK, INTERPOLATED, NO_FIX, SPOOFED, UNREADABLE)
LOCATED_STATUSES = (OK, INTERPOLATED)

# Text formats (fixed values).
GPS_TEXT_REGEX = (
    r"^(?:(\d{1,3}) KM/H ?)?(?:([NS])(\d{1,2}\.\d+))? ?(?:([EW])(\d{1,3}\.\d+))?$"
)
CLOCK_TEXT_REGEX = r"^(\d{1,4})[/.](\d{1,2})[/.](\d{1,4}) (\d{1,2}):(\d{2}):(\d{2})$"
RAW_TEXT_SEPARATOR = " | "

# --- cleaning -----------------------------------------------------------------------------
CLOCK_JITTER_S = 1.5
SPEED_CHECK_SPAN_S = 5
MIN_SPEED_PAIRS = 5
MAX_MEDIAN_SPEED_MISMATCH_KMH = 30.0
MAX_SPEED_KMH = 250.0
MAX_PLACE_JUMP_KMH = 1000.0
MAX_CLOCK_DATE_DIFF_DAYS = 1
MAX_MERGE_GAP_S = 12 * 3600
MAX_INTERPOLATION_GAP_S = 60
MAX_MONTH = 12

# --- earth --------------------------------------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180.0

# --- geometry -----------------------------------------------------------------------------
GEOMETRY_MIN_STEP_M = 10.0
GEOMETRY_TOLERANCE_M = 5.0
GEOMETRY_DECIMALS = 5
MAX_MARKER_STEP_S = 3

# --- map matching -------------------------------------------------------------------------
GPS_SIGMA_M = 12.0
SEARCH_RADIUS_M = 50.0
OFF_ROAD_COST = 3.0
HEADING_WEIGHT = 3.0
SWITCH_COST = 4.0
MIN_HEADING_DISPLACEMENT_M = 10.0
MAX_HEADING_WINDOW = 5
MAX_RUN_STEP_S = 5.0
MAX_RUN_STEP_M = 150.0
MIN_STRETCH_M = 50.0
ENRICHER_VERSION = 1
LOCALITY_RADII_M = {"city": 5000.0, "town": 2500.0, "village": 1200.0, "hamlet": 500.0}
LOCALITY_POPULATION_FACTOR = 10.0
MAX_LOCALITY_RADIUS_M = 25000.0
CHUNK_NODES = 8
DRIVABLE_CLASSES = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link",
    "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified",
    "residential", "living_street", "service", "road",
)
PLACE_TYPES = ("city", "town", "village", "hamlet")

# --- library and names --------------------------------------------------------------------
EXTRACTOR_VERSION = 1
CLEANING_VERSION = 2
INDEX_FORMAT_VERSION = 3
EXTRACTION_OK = "ok"
EXTRACTION_NO_OVERLAY = "no_overlay"
VIDEO_EXTENSIONS = ("mp4", "mov", "avi")
MAX_FILENAME_BYTES = 143
MAX_FILENAME_LENGTH = 140
FORBIDDEN_FILENAME_REGEX = r'[/\\:*?"<>|\x00-\x1f]'
FORBIDDEN_FILENAME_TEXT = '/ \\ : * ? " < > |'
TRIP_NAME_REGEX = r"^(\d{4}-\d{2}-\d{2})\s*(.*)$"
PLACEHOLDER_NAME_REGEX = r"^Trip \d{2}-\d{2}$"
CLIP_NAME_REGEX = r"^(\d{14})_(\d+)$"
PARKING_CLIP_REGEX = r"(?i)^\d{14}_\d+P$"
TRAILING_INDEX_REGEX = r"(\d+)$"
LOCKED_FOLDER = "ro"
TRIP_GAP_HOURS = 3.0
MIN_LEFTOVER_AGE_S = 3600
FINGERPRINT_CHUNK_BYTES = 1 << 20
MIN_FRAME_WIDTH = 1280
PROBE_FRAMES = 10
PROBE_MIN_CLOCKS = 3
CELL_WIDTH_PX = 18
CELL_PITCH_PX = 18

MIN_NAMED_STRETCH_M = 300.0
STREET_SEPARATOR = ", "
REF_HIGHWAY_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link")

# Street-type words dropped from English names (fixed values).
ENGLISH_STREET_TYPE_WORDS = (
    "street", "st", "st.", "avenue", "ave", "ave.", "square", "lane", "boulevard", "blvd",
    "road", "rd", "highway", "drive", "passage", "embankment", "descent", "alley", "way",
    "bridge", "prospekt", "prospect", "vulytsia", "ploshcha", "provulok", "entrance", "exit",
    "blind",
)
# Street-type words dropped from Ukrainian names (fixed values).
UKRAINIAN_STREET_TYPE_WORDS = (
    "вулиця", "вул.", "проспект", "просп.", "пр.", "площа", "пл.", "провулок", "пров.",
    "бульвар", "бул.", "шосе", "дорога", "узвіз", "набережна", "проїзд", "тупик", "майдан",
    "алея", "шлях", "тракт", "траса", "міст", "спуск", "в'їзд", "в’їзд", "з'їзд", "з’їзд",
    "улица",
)
# KMU 2010 transliteration (fixed values): letter -> Latin form inside a word.
KMU_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie",
    "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ь": "", "ю": "iu",
    "я": "ia", "ё": "io", "ъ": "", "ы": "y", "э": "e",
}
# The letters written differently at the start of a word (fixed values).
KMU_INITIAL_LETTERS = {"є": "ye", "ї": "yi", "й": "y", "ю": "yu", "я": "ya", "ё": "yo"}
APOSTROPHES = "'’ʼ`"

# --- reports and heatmap ------------------------------------------------------------------
SPEED_BUCKET_UPPER_KMH = (20, 40, 60, 90, 120)
SPEED_BUCKET_LABELS = ("< 20", "20-40", "40-60", "60-90", "90-120", "120+")
GOOD_COVERAGE, PARTIAL_COVERAGE = 0.95, 0.7
STATUS_GOOD_PERCENT, STATUS_FAIR_PERCENT = 90, 50
HEAT_CELL_M = 10.0
HEAT_MIN_LEVEL = 0.25
HEAT_MIN_SCALE_COUNT = 10
HEAT_OVERLAP = 4
HEAT_RADIUS_PX = 5
HEAT_METERS_PER_DEGREE = 111_320.0
EARTH_CIRCUMFERENCE_M = 40_075_016.686
WORLD_WIDTH_PX = 256

# --- reading-quality report ----------------------------------------------------------------
QUALITY_COORDINATE_STEP_DEG = 0.01
QUALITY_CLOCK_DRIFT_S = 1.5
QUALITY_SPEED_MISMATCH_KMH = 25.0
QUALITY_MAX_REPORTED = 15
