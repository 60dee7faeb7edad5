"""Building blocks that keep a plan safe at scale: sized lookups, order statistics, ids."""
