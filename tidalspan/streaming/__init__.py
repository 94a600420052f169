"""Learning and prediction over streams."""
