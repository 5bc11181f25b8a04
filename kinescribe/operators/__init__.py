"""DataFrame -> DataFrame operators over runs of timed observations and segments."""
