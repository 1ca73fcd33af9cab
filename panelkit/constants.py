"""Fixed values of the research panel."""

#: Trading days of a year.
TRADING_DAYS = 252
ROLLING_WINDOWS = {"tiny": 5, "short": 20, "medium": 60, "long": 252}
#: A signal above or below these is a long or a short position.
LONG_THRESHOLD, SHORT_THRESHOLD = 0.8, -0.8
