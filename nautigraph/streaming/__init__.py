"""nautigraph.streaming"""
