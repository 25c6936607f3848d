"""Fixed values of the three domains."""

# fixed values: class vocabulary, id = 2 * app + mode
APPS = ["Discord", "GoogleMeet", "Messenger", "WhatsApp", "Zoom"]
MODES = ["voice", "video"]
LABELS = [f"{app}_{mode}" for app in APPS for mode in MODES]
N_CLASSES = len(LABELS)
N_PACKETS = 5

# fixed values: packet-length bands in bytes, lower bound inclusive, upper bound exclusive
BANDS = {"tiny": (0, 100), "audio": (100, 300), "mid": (300, 1100), "mtu": (1100, 1600)}
AUDIO_LIMIT = 300

# fixed values: burst thresholds in seconds
BURST_GAPS = [0.0005, 0.001, 0.005, 0.020]

# fixed values: pseudo-group rounding, source calls per class in train and test
GROUP_BYTES = 8
CALLS_TRAIN = 40
CALLS_TEST = 10

# fixed values: audit grid
N_CHECKPOINTS = 41
VERDICTS = ["1", "0", "N/A"]
TRACKS = list(range(1, 10))

TIMES = [f"relative_time_{i}" for i in range(N_PACKETS)]
LENGTHS = [f"packet_length_{i}" for i in range(N_PACKETS)]
FLOW_COLUMNS = [c for pair in zip(TIMES, LENGTHS) for c in pair]
