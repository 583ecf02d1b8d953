"""Model fits: data passes on Spark return statistics of bounded size, the driver solves small systems."""
