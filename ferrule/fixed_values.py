"""Fixed values that define results: word lists, constants and limits."""

from __future__ import annotations

import math
import unicodedata

# --- ranking -------------------------------------------------------------------------------
CANDIDATES = 200
RRF_K = 60
DIR_ARM_SCALE = 2.0 / 2.6
DIR_FROM_CHILDREN_WEIGHT = 0.6
MAX_DIR_FRACTION = 0.34
DEFAULT_LIMIT = 40
DEFAULT_FLOOR = 0.55
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
BM25_FILE_WEIGHTS = {"path": 1.0, "name": 3.0, "body": 1.0}
BM25_DIR_WEIGHTS = {"path": 1.0, "name": 3.0}
RERANK_HEAD, RERANK_POOL_LEAST, RERANK_POOL_MOST = 2000, 20, 100

# --- text ----------------------------------------------------------------------------------
PROFILE_TOKENS = {"content": 256, "code": 64, "name-only": 0}
CHARS_PER_TOKEN = 4
SNIPPET_CHARS = 300
SNIFF_BYTES = 8192
PROBE_CAP, PROBE_LARGE, PROBE_SOURCE_RATIO = 60_000, 20_000, 0.6

# --- topics --------------------------------------------------------------------------------
MAX_CENTROID_WEIGHT = 0.5
TOPIC_EPOCHS, TOPIC_SAMPLE, TOPIC_SEED = 5, 100_000, 42
TOPIC_MAX_K, TOPIC_MAX_EPOCHS, TOPIC_DEFAULT_MAX_K, LABEL_MEMBERS = 1024, 20, 256, 500
EMA_COUNT, LEAST_COUNT, REVIVAL, SPLIT, ALPHA_FLOOR, REVIVAL_EVERY = 1 / 65536, 1e-300, 0.1, 1e-4, 0.1, 5

REFRESH_SECONDS = {"every-run": 0, "daily": 86_400, "weekly": 604_800, "manual": None}

# --- words that name no topic --------------------------------------------------------------
LABEL_STOPWORDS = (
    "the and for with from into over this that home users documents document downloads desktop pictures music videos "
    "video public storage transfer misc stuff other backup backups copy temp tmp data files file new final untitled "
    "screenshot screenshots img dsc user"
).split()
FORMAT_WORDS = (
    "pdf jpg jpeg png gif webp svg bmp tif tiff txt md rtf doc docx odt xls xlsx ods csv ppt pptx odp mp3 wav flac ogg "
    "m4a aac wma au aup mp4 mkv avi mov webm wmv zip tar gz bz2 xz zst 7z rar iso img exe dll so bin json xml yaml yml "
    "toml ini cfg conf html htm css js ts rs py c h cpp hpp java sh ps1 bat url lnk desktop flp als logic band eff"
).split()

# --- extensions ----------------------------------------------------------------------------
MEDIA_EXTENSIONS = "jpg jpeg png gif webp tiff tif bmp heic avif raw cr2 nef mp4 mkv avi mov webm flv wmv mp3 flac wav ogg opus m4a aac".split()
OFFICE_EXTENSIONS = "docx odt pptx odp xlsx ods".split()
SOURCE_EXTENSIONS = (
    "c h cc cpp cxx hpp hh py rs go js mjs cjs ts tsx jsx java kt kts scala swift m mm cs rb php pl pm lua sh bash zsh "
    "fish sql s asm dts dtsi vhd v sv ex exs erl hs ml clj jl r f90 for pas zig nim dart"
).split()

# --- what a walk leaves out ----------------------------------------------------------------
IGNORED = (
    ".git/ .hg/ .svn/ .bzr/ .jj/ node_modules/ __pycache__/ .mypy_cache/ .pytest_cache/ .ruff_cache/ .tox/ .venv/ venv/ "
    "site-packages/ target/debug/ target/release/ .gradle/ .m2/ .cargo/registry/ .rustup/ .npm/ .pnpm-store/ .yarn/ "
    ".next/ .nuxt/ .svelte-kit/ .terraform/ vendor/ third_party/ .cache/ .local/share/Trash/ .thumbnails/ .Trash-*/ "
    "*.pyc *.pyo *.o *.a *.so *.so.* *.ko *.obj *.lib *.dll *.dylib *.class *.jar *.war *.rlib *.rmeta *.d *.cmd *.gcda "
    "*.gcno *.tar *.tar.* *.tgz *.gz *.bz2 *.xz *.zst *.7z *.rar *.deb *.rpm *.apk *.AppImage *.iso *.img *.qcow2 *.vmdk "
    "*.dmg *.lock *.pack *.idx *.map *.min.js *.min.css *.mo *.pdb *.sqlite-wal *.sqlite-shm *.woff *.woff2 *.ttf *.otf *.eot"
).split()


def _diacritics() -> tuple[str, str]:
    """Letters that decompose into an ASCII letter and marks, and those ASCII letters: built
    from the Unicode tables."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and parts[0].isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


DIACRITICS, PLAIN_LETTERS = _diacritics()


# --- laws of the mini-batch recipe ---------------------------------------------------------
def nearest_power_of_two(value: float) -> int:
    """In log space; a tie goes up."""
    if value <= 1:
        return 1
    low = 2 ** math.floor(math.log2(value))
    return low if value / low < 2 * low / value else 2 * low


def batch_recipe(n: int, k: int, epochs: int) -> tuple[int, float, int]:
    """Batch size, first step size and number of steps for n rows and k clusters."""
    wanted = nearest_power_of_two(0.035134 * k**0.134749 * n**0.876473 * epochs**0.813344)
    batch = max(1, min(wanted, nearest_power_of_two(n / 2), n))
    first = 0.8244 * k**-0.4617 * batch**0.9003 * n**-0.4498 * epochs**-0.1057
    return batch, min(1.0, max(1e-4, first)), math.ceil(n / batch) * epochs


def default_topic_count(n: int) -> int:
    return min(n, max(2, min(TOPIC_DEFAULT_MAX_K, math.floor(math.sqrt(n) + 0.5))))
