"""Fixed values of the recording protocol and of the experiment grid."""

# Sampling rate in Hz and the mean absolute amplitude above which a
# channel counts as connected.
SAMPLING_RATE = 250
VALID_CHANNEL_THRESHOLD = 1e-15

# Trial protocol, in seconds, and trial labels.
BLOCKS_PER_SECOND = 2
TRIAL_COUNT = 10
TRIAL_LENGTH_S = 10
TRIAL_LABELS = ["movement", "rest"]
EVENT_OFFSET_S = 1
EVENT_LENGTH_S = 4

# The sweep grid.
SWEEP_CHANNELS = ["C1", "C2", "C5", "C3", "C4", "C6", "FC3", "CP3", "FC4", "CP4", "CZ"]
SWEEP_START_HZ = 2
SWEEP_STOP_HZ = 30
SWEEP_WIDTHS = [1, 2, 3, 4, 5, 6, 7]

# Block scoring band and block limit.
LIVE_BAND = (14, 20)
LIVE_BLOCK_LIMIT = 20

# Amplifier rate -> scans per block, and the fallback.
SCANS_PER_BLOCK = {250: 8, 500: 15}
DEFAULT_SCANS_PER_BLOCK = 8
INTERNAL_RATE = 4000
