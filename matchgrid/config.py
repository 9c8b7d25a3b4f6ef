"""Constants of the domain, in one place."""

# Fixed values.
BANKROLL = 1000.0
MIN_EDGE, SUSPECT_EDGE = 0.02, 0.15
KELLY_FRACTION, MAX_BET, MAX_EXPOSURE = 0.25, 0.05, 0.25
SHRINK, SIDE_FLOOR = 0.6, 0.30
ELO_START, ELO_K, ELO_HOME, ELO_CARRY = 1500.0, 20.0, 100.0, 0.75
PYTHAGOREAN = 14.0
WINDOWS, SPLIT_WINDOWS, B2B_WINDOWS, HALF_LIFE = (5, 10, 20), (10, 20), (5, 10), 10
DEDUP_HOURS, DEDUP_PROB, DEDUP_POINTS = 4, 0.005, 0.5
SPREAD_EDGE, TOTAL_EDGE = 1.5, 2.5
SLATE_RHO, PORTFOLIO_RHO = 0.15, 0.05
ELO_WEIGHT = 0.3
