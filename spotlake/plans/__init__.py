"""End-to-end jobs: report cleaning, spot catalogue, airing reports, classification."""
