"""Fixed values. They decide results, so they are stated once, here."""

# File extension -> category folder.
CATEGORY_BY_EXT = {
    "mp4": "videos",
    "wav": "audio",
    "txt": "text",
    "json": "text",
    "xlsx": "metadata",
}
SUPPORTED_EXTS = tuple(CATEGORY_BY_EXT)

# Video codecs the accelerated path can decode.
SUPPORTED_CODECS = ("h264", "avc1", "hevc", "hev1", "h265", "vp09", "vp9")

MIN_FRAMES = 8  # fewer frames than this are too short
VFR_TOLERANCE = 0.01  # relative gap between nominal and average frame rate
MAX_ERR_RATE = 0.05  # a measurement is trusted below this rate
BATCH_SIZE = 200  # files per batch
PROGRESS_EVERY = 250  # files between two progress marks
REPORTED_ERRORS = 5  # error samples shown in a summary
NEEDLE = "the"  # word looked for in texts
N_FFT = 1024  # spectrum window

# Collection sizes at which a speedup curve is read.
CURVE_CHECKPOINTS = (10, 50, 100, 250, 500, 1000, 2000, 5000)
