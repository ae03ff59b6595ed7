"""Patterns, word lists, weights and limits that results depend on, stated as they are.

Patterns are Java regular expressions; ``(?iuU)`` gives case-insensitive matching with Unicode classes.
"""

from __future__ import annotations

I = "(?iuU)"  # noqa: E741
U = "(?U)"

# --- Fixed values: files -------------------------------------------------------------------------------------------
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v", "m2ts", "ts", "mpg", "mpeg", "vob", "iso")
VIDEO_SUFFIX = I + r"\.(?:mkv|mp4|avi|m2ts|ts|m4v|mov|wmv|flv|webm|mpg|mpeg|vob|iso)$"

# --- Fixed values: season, episode and year in names ---------------------------------------------------------------
SERIES = I + r"(?:^|[.\s-])+S(\d{1,2})(?:E(\d{1,3}))?"
SERIES_X = I + r"(?:^|[.\s-])(\d{1,2})x(\d{2,3})"
EPISODE_ALONE = U + r"(?:^|[.\s-])(\d{2,3})(?:\s*v\d+)?(?=\s*[\[\(]|\s*$|\.\w+$|\.\s)"
EPISODE_BRACKETS = U + r"\[(\d{2,3})(?:_of_\d+)?\]"
SEASON_DOT_EPISODE = U + r"(?:^|[.\s-])(\d{1,2})\.(\d{2,3})\."
SEASON_DOT_DIGIT = U + r"^(\d{1,2})\.(\d)(?:\.|$)"
YEAR = U + r"(?<![a-zA-Z])((?:19|20)\d{2})(?![a-zA-Z]|p|i)"
EXTENSION = r"\.([a-zA-Z0-9]+)$"
NOT_EPISODES = (480, 576, 720)
MULTI_MARKER = U + r"(?:^|[.\s\-_+&,])+(?:s\d{1,2}e\d{1,3}|\d{1,2}x\d{2,3})"
#: What follows a marker where a second episode may: all that ``names.episode_pairs`` finds, and some more.
SECOND_EPISODE = U + r"(?:^|[.\s\-_+&,])(?:s\d{1,2}e\d{1,3}+|\d{1,2}x\d{2,3}+)(?:[.\s\-_+&,]|and)*+(?:[se]\d|\d{1,2}x\d|(?!\d{4}|(?:480|576|720)(?!\d))\d)"
RESOLUTION_WIDTHS = ("480", "576", "720", "1080", "2160")
TECH_UNITS = I + r"^[\s.\-]*(?:bit|bits|fps|hz|khz|mhz|ch|channels?|kbps|mbps|vbr|cbr)\b"
MAX_RANGE_GAP = 2
SPECIAL_MARKER = I + r"\[(?:Special|OVA|OAV|OAD|Extra|Movie|Film|Omake|SP|OVD)\]|\.(?:Special|OVA|OAV|OAD|Extra|Movie|Film|Omake|SP|OVD)\."

# --- Fixed values: what title cleaning removes -----------------------------------------------------------------------
QUALITY_TOKENS = I + (
    r"\b(?:480[ip]|576[ip]|720[ip]|1080[ip]|2160[ip]|UHD|4K|[xh]\.?26[45]|HEVC|AV1|VP9|Xvid|Divx|AVC"
    r"|DD\W?5[. ]1|DDP?5[. ]1|AAC5[. ]1|TrueHD|DTS[ -]HD|DTS|FLAC|AAC|AC3|MP3|PCM|Opus|8bit|10bit|8-bit|10-bit"
    r"|HDR10?|Dolby[. ]?Vision|DOVI|DV|HLG|HDR|SDR|x265|h\.265|848x480|1280x720|1920x1080|3840x2160|4096x2160"
    r"|Remux|MULTi|DUAL[. ]?AUDIO|5[. ]1|7[. ]1|2[. ]0)\b"
)
SOURCE_TOKENS = I + r"\b(?:BluRay|WEB[-_. ]?DL|WEBRip|BDRip|BRRip|HDTV|DVD|DVDR|SCREENER|TELESYNC|TELECINE|WORKPRINT|PDTV|SDTV|TVRip)\b"
BLACK_BARS = I + r"\b(?:uncut|uncropped)[._\s-]+(?:black|bars)\b|\b(?:black|bars)[._\s-]+(?:uncut|uncropped)\b"
RELEASE_GROUP = U + r"[-. ]*-[-. ]*[a-zA-Z0-9À-ɏ]{2,15}$"

# --- Fixed values: quality dimensions, first match wins --------------------------------------------------------------
RESOLUTIONS = (
    (2160, r"\b(?:2160p|3840x2160|4096x2160|4k[-_. ](?:UHD|HEVC|BD|H\.?265)|(?:UHD|HEVC|BD|H\.?265)[-_. ]4k)\b"),
    (2160, r"\bUHD\b"),
    (1080, r"\b(?:1080p|1920x1080|1440p|FHD|1080i)\b"),
    (720, r"\b(?:720p|1280x720|960p)\b"),
    (576, r"\b576p\b"),
    (480, r"\b(?:480p|480i|640x480|848x480)\b"),
    (360, r"\b360p\b"),
    (540, r"\b540p\b"),
)
SOURCES = (
    ("BluRay", r"\b(?:M?Blu[-_. ]?Ray|HD[-_. ]?DVD|BD(?!$)|UHD2?BD|BDISO|BDMux|BD25|BD50|BR[-_. ]?DISK)\b"),
    ("WEB-DL", r"\b(?:WEB[-_. ]?DL(?:mux)?|AmazonHD|AmazonSD|iTunesHD|MaxdomeHD|NetflixU?HD|WebHD|HBOMaxHD|DisneyHD)\b"),
    ("WEB-DL", r"[. ]WEB[. ](?:[xh][ .]?26[45]|AVC|HEVC|DDP?5[. ]1)"),
    ("WEB-DL", r"\bAMZN[. -]WEB[. -](?!Rip)\b"),
    ("WEBRip", r"\b(?:WebRip|Web-Rip|WEBMux)\b"),
    ("HDTV", r"\bHDTV\b"),
    ("BDRip", r"\b(?:BDRip|BDLight|HD[-_. ]?DVDRip|UHDBDRip)\b"),
    ("BRRip", r"\bBRRip\b"),
    ("DVD", r"\bDVD(?!-R)\b"),
    ("DVDR", r"\b\d?x?M?DVD-?[R59]\b"),
    ("SCREENER", r"\b(?:SCR|SCREENER|DVDSCR|DVDSCREENER)\b"),
    ("TELESYNC", r"\b(?:TS[-_. ]|TELESYNCH?|HD-TS|HDTS|PDVD|TSRip|HDTSRip)\b"),
    ("TELECINE", r"\b(?:TC|TELECINE|HD-TC|HDTC)\b"),
    ("CAM", r"\b(?:CAMRIP|(?:NEW)?CAM|HD-?CAM(?:Rip)?|HQCAM)\b"),
    ("WORKPRINT", r"\b(?:WORKPRINT|WP)\b"),
    ("PDTV", r"\bPDTV\b"),
    ("SDTV", r"\bSDTV\b"),
    ("TVRip", r"\bTVRip\b"),
)
CODECS = (
    ("AV1", r"\bAV1\b"),
    ("HEVC", r"\b(?:HEVC|h\.?265|x265)\b"),
    ("x264", r"\b(?:x264|h\.?264|AVC)\b"),
    ("VP9", r"\bVP9\b"),
    ("XviD", r"\bX-?vid\b"),
    ("DivX", r"\bdivx\b"),
    ("VC-1", r"\bVC[-_. ]?1\b"),
    ("MPEG-2", r"\bMPEG[-_. ]?2\b"),
)
AUDIO = (
    ("TrueHD", r"\bTrueHD\b"),
    ("DTS-HD", r"\bDTS[-_. ]?HD(?:MA)?\b"),
    ("DTS", r"\bDTS(?![-_.]HD\b)\b"),
    ("FLAC", r"\bFLAC\b"),
    ("AAC", r"\bAAC5[. ]1\b"),
    ("AAC", r"\bAAC\b"),
    ("AC3", r"\b(?:AC3|DDP?5[. ]1)\b"),
    ("MP3", r"\bMP3\b"),
    ("PCM", r"\bPCM\b"),
    ("Opus", r"\bOpus\b"),
)
HDR = (
    ("Dolby Vision", r"\b(?:Dolby[ .-]?Vision|DOVI|DV)\b"),
    ("HDR10+", r"\bHDR10\+?\b"),
    ("HDR10", r"\bHDR10\b(?!\+)"),
    ("HLG", r"\bHLG\b"),
    ("HDR", r"\bHDR\b(?!10)"),
)
REMUX = r"(?:[_. \[]|\d{4}p-|\bHybrid-)(?:(BD|UHD)[-_. ]?)?Remux\b|(?:(BD|UHD)[-_. ]?)?Remux[_. ]\d{4}p"
THREE_D = r"\b3D\b"
MODIFIERS = (
    ("Special Edition", r"\bSpecial[. ]Edition\b"),
    ("Collector's Edition", r"\bCollector['´`]?s[. ]Edition\b"),
    ("Alternative Cut", r"\b(?:Alternative|Alternate)[. ]Cut\b"),
    ("Director's Cut", r"\b(?:Director['´`]?s|Directors)[. ]?Cut\b"),
    ("Theatrical Cut", r"\bTheatrical[. ]Cut\b"),
    ("Extended Cut", r"\bExtended[. ]Cut\b"),
    ("Fan Edit", r"\bFan[. ]Edit\b"),
    ("Open Matte", r"\bOpen[. ]?Matte\b"),
    ("IMAX Enhanced", r"\bIMAX[. ]Enhanced\b"),
    ("Criterion Edition", r"\bCriterion[. ]Edition\b"),
    ("Extended", r"\bExtended\b"),
    ("Unrated", r"\bUnrated\b"),
    ("Uncut", r"\bUncut\b"),
    ("Remastered", r"\bRemastered\b"),
    ("Restored", r"\bRestored\b"),
    ("Theatrical", r"\bTheatrical\b"),
    ("IMAX", r"\bIMAX\b"),
    ("Internal", r"\bINTERNAL\b"),
    ("Proper", r"\b(?:PROPER|REPACK)\b"),
    ("Convert", r"\bCONVERT\b"),
    ("Upscaled", r"\b(?:Upscaled|Upscale|UPSCALED)\b"),
    ("Hybrid", r"\bHybrid\b"),
    ("DC", r"\bDC\b"),
    ("SE", r"\bSE\b"),
    ("CE", r"\bCE\b"),
    ("OM", r"\bOM\b"),
    ("INT", r"\bINT\b"),
)
#: What any match of a rule for audio, HDR, remux, 3D or modifiers holds, in ASCII texts.
RARE = (
    r"(?i)remux|\b(?:TrueHD|DTS|FLAC|AAC|AC3|DD|MP3|PCM|Opus|Dolby|DOVI|DV|HDR|HLG|3D|Special|Collector|Altern|Director|Theatrical|Extended|Fan|Open|IMAX|Criterion|Unrated|Uncut"
    r"|Rema|Restored|Internal|Proper|Repack|Convert|Upscale|Hybrid|DC|SE|CE|OM|INT)"
)

# --- Fixed values: directories ---------------------------------------------------------------------------------------
GENERIC_WORDS = (
    "downloads", "video", "videos", "tv", "movies", "series", "anime", "season", "seasons", "episodes", "specials",
    "complete", "batch", "vol", "volume", "disc", "disk", "media", "data", "mnt", "storage", "shared", "home",
    "library", "collection", "shows", "films", "cartoons", "user", "tmp", "temp", "var", "opt", "usr", "etc", "root",
    "private", "system", "system32", "windows", "program", "programs", "program files",
)
SUPPLEMENTARY_DIRS = (
    r"^extras$", r"^bonus$", r"^bonus[- .]?features?$", r"^featurettes?$", r"^supplemental$", r"^extra[- .]?features?$",
    r"^extra[- .]?episodes?$", r"^extra$", r"^trailers?$", r"^teasers?$", r"^promos?$", r"^deleted[- .]?scenes?$",
    r"^extended[- .]?scenes?$", r"^alternate[- .]?scenes?$", r"^behind[- .]?the[- .]?scenes$", r"^making[- .]?of$",
    r"^bts$", r"^on[- .]?the[- .]?set$", r"^interviews?$", r"^gag[- .]?reels?$", r"^outtakes?$", r"^bloopers?$",
    r"^screen[- .]?tests?$", r"^camera[- .]?tests?$", r"^storyboards?$", r"^animatics?$", r"^documentar(?:y|ies)$",
    r"^samples?$", r"^specials?$", r"^bdmv$", r"^certificate$", r"^\.extras$",
)
SUPPLEMENTARY_STEMS = (
    r"^trailer$", r"^teaser$", r"^promo$", r"^sample$", r"^featurette$", r"^outtakes?$", r"^bloopers?$",
    r"^screen[- .]?tests?$", r"^camera[- .]?tests?$", r"^storyboards?$", r"^storyboard[- .]?comparisons?$",
    r"^animatics?$", r"^documentar(?:y|ies)$", r"^interview[- .]", r"^interviews[- .]", r"^cast[- .]?interview",
    r"^behind[- .]?the[- .]?scenes", r"^making[- .]?of", r"^on[- .]?the[- .]?set", r"^bts[- .]",
    r"^deleted[- .]?scenes?", r"^extended[- .]?scenes?", r"^alternate[- .]?scenes?", r"^alternate[- .]?ending",
    r"^gag[- .]?reel", r"^short[- .]?film", r"^mini[- .]?feature", r"^q[- .]?&?[- .]?a", r"making[- .]?of$",
    r"the[- .]?making[- .]?of$", r"behind[- .]?the[- .]?scenes$",
)
SEASON_WORDS = (("shi", 4), ("san", 3), ("ni", 2), ("two", 2), ("go", 5), ("roku", 6), ("nana", 7), ("shichi", 7), ("hachi", 8), ("kyuu", 9), ("ku", 9), ("juu", 10))
ROMAN = (("i", 1), ("ii", 2), ("iii", 3), ("iv", 4), ("v", 5), ("vi", 6), ("vii", 7), ("viii", 8), ("ix", 9), ("x", 10))

# --- Fixed values: scripts, file names, templates --------------------------------------------------------------------
SCRIPTS = (
    ("ru", r"[\x{400}-\x{52F}]"),
    ("ja", r"[\x{3040}-\x{9FFF}\x{AC00}-\x{D7AF}]"),
    ("ar", r"[\x{600}-\x{6FF}]"),
    ("el", r"[\x{370}-\x{3FF}]"),
    ("th", r"[\x{E00}-\x{E7F}]"),
)
LOOKALIKES = (("?", "？"), ("*", "×"), (":", "∶"), ("/", "∕"), ("\\", "∖"), ("<", "‹"), (">", "›"))
QUOTES = ("“", "”")
TEMPLATE_MOVIE = "{title} ({year}) {mod}.{ext}"
TEMPLATE_SERIES = "{season:02d}.{episode:02d}. {ep_title}.{ext}"
TEMPLATE_MOVIE_FALLBACK = "{title} ({year}).{ext}"
LEADING_ARTICLE = I + r"^(?:the|a|an|les|le|la|el|las|los|der|das|die|un|une|ein|eine)\s+"
TRAILING_GENERIC = I + r"\s+(?:the\s+series|the\s+anime|the\s+tv\s+series|the\s+show|tv)$"
DISAMBIGUATION = I + r"\s*\(\s*(?:film|pel[íi]cula|movie|tv series|serie|film\s*,\s*\d{4})[^)]*\)\s*$"

# --- Fixed values: evidence ------------------------------------------------------------------------------------------
PROVIDERS = ("filename", "dirname", "file", "wikipedia", "tvmaze", "tmdb")
WEIGHTS = {
    "season": {"wikipedia": 5.0, "tvmaze": 5.0, "tmdb": 5.0, "filename": 4.0, "dirname": 2.0, "file": 1.0},
    "episode": {"wikipedia": 5.0, "tvmaze": 5.0, "tmdb": 5.0, "filename": 4.0, "dirname": 2.0, "file": 1.0},
    "ep_title": {"wikipedia": 5.0, "tvmaze": 5.0, "tmdb": 5.0},
    "title": {"wikipedia": 5.0, "tvmaze": 5.0, "tmdb": 5.0, "filename": 1.0, "dirname": 1.0},
    "year": {"tmdb": 5.0, "wikipedia": 4.0, "tvmaze": 4.0, "dirname": 1.0, "filename": 1.0},
    "resolution": {"file": 5.0, "dirname": 1.0, "filename": 1.0},
    "codec": {"file": 5.0, "dirname": 1.0, "filename": 1.0},
    "audio_codec": {"file": 5.0, "dirname": 1.0, "filename": 1.0},
    "channels": {"file": 5.0, "dirname": 1.0, "filename": 1.0},
    "quality": {"file": 5.0, "dirname": 1.0, "filename": 1.0},
}
EXPENSIVE = ("season", "episode")
SINGLE_EFFECTIVE, SINGLE_CONFIDENCE, CONSENSUS_CONFIDENCE = 1.1, 0.6, 0.6
TITLE_RATIO, WEAK_FACTOR, CHEAP_SHARE, POSTERIOR_CAP = 0.85, 0.5, 0.5, 0.999
NUMBERED_EPISODE = I + r"^(?:episode|ep|ep\.)\s*\d{1,3}$"

# --- Fixed values: containers and catalogs ---------------------------------------------------------------------------
TAG_ALIASES = (
    ("show_name", "show_name"), ("series_name", "show_name"), ("WM/ShowName", "show_name"), ("title", "ep_title"),
    ("WM/Title", "ep_title"), ("season_number", "season"), ("season", "season"), ("WM/SeasonNumber", "season"),
    ("episode_sort", "episode"), ("episode_number", "episode"), ("episode", "episode"), ("WM/EpisodeNumber", "episode"),
)
STREAM_CODECS = (
    ("h264", "x264"), ("h.264", "x264"), ("avc", "x264"), ("h265", "HEVC"), ("h.265", "HEVC"), ("hevc", "HEVC"),
    ("av1", "AV1"), ("vp9", "VP9"), ("mpeg4", "XviD"), ("mpeg2video", "MPEG-2"), ("vc1", "VC-1"),
)
HEIGHTS, HEIGHT_SLACK = (2160, 1080, 720, 576, 480, 360), 144
HLG_TRANSFERS = ("arib-std-b67", "bt2020-10", "bt2020-12")
FILM_TYPES = ("Q11424", "Q1259759", "Q2002065", "Q210294")
SERIES_TYPES = ("Q5398426", "Q15416", "Q2485448", "Q581714", "Q21191270", "Q1107", "Q21198342")
WORK_TYPES = ("Q8261", "Q7725634")
CACHE_DAYS = 7
SEARCH_HITS = 3
MIN_SHOW_SCORE = 0.5
AUDIO_LABELS = (
    ("aac", "AAC"), ("ac3", "AC3"), ("eac3", "E-AC3"), ("dts", "DTS"), ("truehd", "TrueHD"), ("flac", "FLAC"), ("mp3", "MP3"),
    ("opus", "Opus"), ("pcm_s16le", "PCM"), ("vorbis", "Vorbis"),
)

# --- Fixed values: wikitext ------------------------------------------------------------------------------------------
WIKI_SPECIALS = "(?iu)original video|original net|ova|oav|oad|special|bonus|extra|omake"
WIKI_HEADING = U + r"(?dm)^={1,6}\s*(.*?)\s*={1,6}\s*$"
WIKI_HEADING_OR_EPISODE = U + r"(?dm)(?:\{\{Episode\s+list(?:/sublist)?\s*\n(?s:.*?)\n\}\}|^={1,6}\s*(?:.*?)\s*={1,6}\s*$)"
WIKI_SEASON_PAGES = (U + r"\{\{:\s*([^}|]+?)\s*\}\}", U + r"\{\{Main\s*\|([^}|]+?)\s*\}\}")
WIKI_REFERENCES = ("<ref[^>]*/>", "(?s)<ref[^>]*>.*?</ref>")
WIKI_LINK = r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]"
WIKI_TITLE_TEMPLATES = (
    I + r"\{\{\s*lang(?:-[a-z]{2,3})?\s*\|\s*[a-z]{2,3}\s*\|\s*([^|{}]+?)\s*\}\}", I + r"\{\{\s*nowrap\s*\|\s*([^|{}]+?)\s*\}\}",
    I + r"(?s)\{\{\s*nihongo\s*\|\s*([^|{}]+?)\s*\|.*?\}\}",
)
WIKI_TEMPLATE = r"\{\{[^{}]*\}\}"
WIKI_DATE_FIELD = r"(?i)\|[ ]*(?:first_aired|last_aired|released|air_date|original_release)[ ]*=[ ]*(?:\{\{[^{}]*\|)?(?:19|20)\d{2}"
# the marker that a number may follow
TAIL_MARKER = U + r"(?:^|[.\s\-_+&/]+)(?:s\d{1,2}e\d{1,3}|\d{1,2}x\d{2,3})"
