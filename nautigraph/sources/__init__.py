"""nautigraph.sources"""
