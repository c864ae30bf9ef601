"""DataFrame operators: shape, features, statistics, quality, profile, recommendation, rewrites."""
