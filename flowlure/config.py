"""Defaults shared by the operators.

Every value under "Fixed values" must stay equal to what the original analysis used,
otherwise results change; everything else is an ordinary default that callers override.
"""

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the original analysis)
# ---------------------------------------------------------------------------------------

# Prefix of the monitored network used by the statistics jobs and the yearly fixed-map job.
NETWORK_PREFIX_WIDE = "147.32."
# Prefix used by the strategy-evaluation, port-evaluation and pair-comparison jobs.
NETWORK_PREFIX_EVAL = "147.32.8"

# A source is an attacker on a day when it touches at least this many hosts ...
MIN_ATTACKED_HOSTS = 5
# ... or at least this many ports.
MIN_ATTACKED_PORTS = 3

# Flow state patterns (Java/RE2 regular expressions, matched anywhere in State).
# A flow whose destination side shows no SYN: the port is unused, a honeypot candidate.
UNUSED_PORT_PATTERN = "_[^S]*(R|F|)[^S]*$"
# A flow whose destination side answered (SYN then ACK): a production service.
ANSWERED_PATTERN = ".*_.*S.*A"

# StartTime layout of the flow archive and the day prefix inside it.
START_TIME_PATTERN = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
START_DAY_PATTERN = r"^\d{4}/\d{2}/\d{2}$"

# Smallest honeypot share a port may get in the allocation game.
MIN_HONEYPOT_SHARE = 0.0001

# Number of most attacked ports the allocation game considers per day.
TOP_PORTS = 25

# Fixed 15-port mixed strategy (port: probability of a honeypot).
MIXED_STRATEGY = {
    21: 0.263346, 22: 0.248634, 23: 0.959599, 25: 0.6516, 80: 0.5, 81: 0.161263,
    443: 0.68306, 445: 0.863388, 1433: 0.371651, 2000: 0.200172, 3306: 0.2762,
    3389: 0.928962, 5900: 0.131671, 8000: 0.16186, 8080: 0.598594,
}
# Fixed 7-port always-on strategy compared against the mixed one.
ALWAYS_ON_STRATEGY = {22: 1, 23: 1, 80: 1, 8080: 1, 3128: 1, 2323: 1, 8123: 1}
# Alternative always-on map of the yearly job.
ALWAYS_ON_ALTERNATIVE = {23: 1, 2323: 1, 22: 1, 80: 1, 8080: 1, 8023: 1, 2380: 1}

# Sampling rate of sources in the pair comparison and its seed.
SOURCE_SAMPLE_RATE = 0.01
SAMPLE_SEED = 42

# ---------------------------------------------------------------------------------------
# Ordinary defaults
# ---------------------------------------------------------------------------------------

ROLL_SEED = "42"
# Maps that the fixed-strategy job can replay.
FIXED_MAPS = {"mixed": MIXED_STRATEGY, "always_on": ALWAYS_ON_STRATEGY, "always_on_alternative": ALWAYS_ON_ALTERNATIVE}
# Decimal places grid parameters are rounded to (float grids such as 0.1 * 3).
GRID_DECIMALS = 6
