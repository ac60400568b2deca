"""nautigraph.functions"""
