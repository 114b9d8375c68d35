"""Relations of the catalog and the constants of its formats."""

from __future__ import annotations

# Fixed values of the formats.
TITLE_KEY_BYTES = 60
SPARSE_STEP = 64
SPARSE_KEY_BYTES = 12
WORD_KEY_CHARS = 13
TITLE_ENTRY_BYTES = 31
POSTING_CAP = 500
BLOCK_BYTES = 60_000
MAX_ARTICLE_BYTES = 16 * 1024 * 1024
ARTICLE_CHUNK_BYTES = 32 * 1024 * 1024
IMAGE_CHUNK_BYTES = 4 * 1024 * 1024
JPEG_QUALITY = 90
MIN_IMAGE_SIDE = 50
THUMB_WIDTH, THUMB_HEIGHT = 320, 212
SCREEN_WIDTH, SCREEN_HEIGHT, NAV_HEIGHT = 320, 240, 28
UI_RESULTS, API_RESULTS, SERVER_RESULTS, HISTORY_CAP = 20, 10, 40, 30
SPARSE_BLOCKS = 15

#: Words left out of the word index; fixed values.
STOP_WORDS = (
    "the of in and for to a an is are was be by or "
    "at on as it its not one two new old all any but "
    "can has had his her our us we he she they this "
    "that with from into than been have were also which "
    "when where who what how may other after both between "
    "see use used being about more most some no so do"
).split()

ENTRIES = "entry_id long, path string, title string, is_redirect boolean, mimetype string, content binary"
TOUCH_EVENTS = "device string, ts_ms long, type string, x int, y int, dy int"
