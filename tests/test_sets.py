"""Each published set over miniature files in its layout."""

import base64
import json

import pytest
from pyspark.sql import Row

from framelake.sources.sets import REGISTRY


@pytest.fixture
def put(tmp_path):
    def write(**files):
        for name, text in files.items():
            p = tmp_path / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(text.encode() or b"1")
        return str(tmp_path)

    return write


def got(spark, name, root, *cols):
    tail = lambda v: v.rsplit("/", 1)[-1] if isinstance(v, str) and v.startswith("file:") else v
    plain = lambda v: tuple(v) if isinstance(v, (Row, list)) else tail(v)
    return sorted((tuple(plain(v) for v in r) for r in REGISTRY.get(name, spark, root).select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name, folder", [("caltech101", "caltech-101/101_ObjectCategories"), ("food101", "food-101"), ("mit67", "Images"), ("objectnet", "objectnet-1.0"), ("eurosat", "x"), ("d2d", "x"), ("lfw", "lfw"), ("mf2", "Megaface_Challenge_1M_disjoint_LOOSE"), ("vggface", "images"), ("places365", "data_256"), ("places365:val", "val_256"), ("vggface2", "n000001")])
def test_folders(spark, put, name, folder):
    root = put(**{f"{folder}/cup/a.jpg": "", f"{folder}/car/b.png": "", f"{folder}/car/notes.txt": ""})
    assert got(spark, name, root, "uri", "category") == [("a.jpg", "cup"), ("b.png", "car")]


def test_names_of_folders_and_files(spark, put):
    root = put(**{"256_ObjectCategories/001.ak47/1.jpg": "", "coil-100/obj7__35.png": "", "coil-100/readme.png": "", "v_ApplyEyeMakeup_g01.avi": "", "person02_boxing_d1.avi": "", "person01_boxing_d1.avi": "", "jump/clip.avi": ""})
    assert got(spark, "caltech256", root, "category") == [("ak47",)]
    assert got(spark, "coil100", root, "category", "attributes") == [("obj7", {"orientation": "35"})]
    assert ("v_ApplyEyeMakeup_g01.avi", "ApplyEyeMakeup") in got(spark, "ucf101", root, "uri", "category")
    assert ("clip.avi", "jump") in got(spark, "hmdb", root, "uri", "category")
    assert got(spark, "kthactions", root, "uri", "category") == [("person02_boxing_d1.avi", "boxing")]
    assert ("person01_boxing_d1.avi",) in got(spark, "kthactions:test", root, "uri")


def test_synsets(spark, put):
    xml = "<annotation><filename>{0}</filename><object><name>n01</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    root = put(**{
        "synset_words.txt": "n01 tench, Tinca\nn02 goldfish\n", "ILSVRC2012_img_train/n01/a.JPEG": "", "ILSVRC2012_img_val/v1.JPEG": "", "ILSVRC2012_img_val/v2.JPEG": "", "val_labels.txt": "n02\nn01\n",
        "ILSVRC2012_bbox_train_v2/n01/a.xml": xml.format("a"), "ILSVRC2013_DET_bbox_val/b.xml": xml.format("b"), "ILSVRC2014_DET_bbox_train/c.xml": xml.format("c"),
        "imagenet21k_wordnet_ids.txt": "n01\nn02\n", "imagenet21k_wordnet_lemmas.txt": "tench, Tinca\ngoldfish\n", "winter21_whole/n02/d.JPEG": "", "imagenet21k_resized/n02/e.JPEG": "",
        "face_annotations_ILSVRC.json": json.dumps([{"url": "a.JPEG", "bboxes": [{"x0": 1, "y0": 2, "x1": 3, "y1": 4}]}]),
        "Images/n02085620-Chihuahua/dog1.jpg": "", "Annotation/n02085620-Chihuahua/dog1": xml.format("dog1"),
    })
    assert got(spark, "imagenet", root, "category", "tags") == [("tench", ("tench", "Tinca"))]
    assert got(spark, "imagenet:val", root, "uri", "category") == [("v1.JPEG", "goldfish"), ("v2.JPEG", "tench")]
    assert got(spark, "imagenet_localization", root, "uri", "category", "box") == [("a", "tench", (1, 2, 3, 4))]
    assert got(spark, "imagenet2014_det:val", root, "uri", "tags") == [("b", ("tench", "Tinca"))] and got(spark, "imagenet2014_det", root, "uri") == [("c",)]
    assert got(spark, "imagenet21k", root, "category") == [("goldfish",)] == got(spark, "imagenet21k_resized", root, "category")
    assert got(spark, "imagenet_faces", root, "uri", "category", "box") == [("a.JPEG", "face", (1, 2, 3, 4))]
    assert got(spark, "stanford_dogs", root, "uri", "category", "box") == [("dog1.jpg", "Chihuahua", (1, 2, 3, 4))]


def test_lists_of_faces(spark, put):
    root = put(**{
        "names.txt": "0000045 Bella_Thorne\n", "0000045/1.jpg": "", "FlickrFinal2/1/2/z.jpg": "", "FlickrFinal2/1/2/z.jpg.json": json.dumps({"bounding_box": {"x": 1, "y": 2, "width": 3, "height": 4}}),
        "facescrub_actors.txt": "name\timage_id\tface_id\turl\tbbox\tsha256\nAl Pa\t1\t2\tu1\t1,2,3,4\tab\n", "facescrub_actresses.txt": "name\timage_id\tface_id\turl\tbbox\tsha256\nBo Di\t1\t2\tu2\t5,6,7,8\tab\n",
        "FDDB-folds/FDDB-fold-01-ellipseList.txt": "2002/08/11/big/img_591\n1\n10 5 1.2 100 50  1\n2002/08/26/big/img_265\n2\n1 2 0 9 9 1\n2 1 0 9 9 1\n",
        "widerface/wider_face_split/wider_face_train_bbx_gt.txt": "0--Parade/0_1.jpg\n1\n449 330 122 149 0 0 0 0 0 0\n0--Parade/0_2.jpg\n0\n0 0 0 0 0 0 0 0 0 0\n",
        "files/Aamir_Khan.txt": "00001 http://u/a.jpg 10.5 20 30 40 2.00 3.9 1\n", "frame_images_DB/R_G.labeled_faces.txt": "R_G\\3\\3.618.jpg,0,262,165,133,132,0.0,1\n",
        "faces.tsv": f"m1\t7\tx\ty\tface-0\tz\t{base64.b64encode(b'JPEG').decode()}\n", "names.tsv": "m1\tAda\n", "lfw/pairs.txt": "10\t300\nA_B\t1\t4\nA_B\t1\tC_D\t3\n",
        "celeba/identity_CelebA.txt": "000001.jpg 2880\n000002.jpg 2937\n", "celeba/list_eval_partition.txt": "000001.jpg 0\n000002.jpg 2\n", "train_list.txt": "n000002/0001_01.jpg\n",
    })
    assert got(spark, "casia", root, "uri", "category", "box") == [("1.jpg", "Bella_Thorne", (13, 13, 237, 237))]
    assert got(spark, "megaface", root, "uri", "category", "box") == [("z.jpg", "z", (1, 2, 4, 6))]
    assert got(spark, "facescrub", root, "uri", "category", "box") == [("u1", "Al_Pa", (1, 2, 3, 4)), ("u2", "Bo_Di", (5, 6, 7, 8))]
    assert got(spark, "fddb", root, "uri", "box") == [("2002/08/11/big/img_591.jpg", (95, 40, 105, 60)), ("2002/08/26/big/img_265.jpg", (7, 8, 11, 10)), ("2002/08/26/big/img_265.jpg", (8, 7, 10, 11))]
    assert got(spark, "widerface", root, "uri", "box") == [("0--Parade/0_1.jpg", (449, 330, 571, 479))]
    assert got(spark, "vggface_urls", root, "uri", "category", "box") == [("http://u/a.jpg", "Aamir_Khan", (10.5, 20, 30, 40))]
    assert got(spark, "youtubefaces", root, "category", "box") == [("R_G", (196, 99, 329, 231))]
    assert got(spark, "msceleb", root, "uri", "category", "content") == [("m1/7-face-0.jpg", "Ada", bytearray(b"JPEG"))]
    assert [(a.rsplit("/", 1)[1], b.rsplit("/", 1)[1], s) for a, b, s in got(spark, "lfw_pairs", root, "uri_a", "uri_b", "same")] == [("A_B_0001.jpg", "A_B_0004.jpg", True), ("A_B_0001.jpg", "C_D_0003.jpg", False)]
    assert got(spark, "celeba", root, "category") == [("2880",)] and got(spark, "celeba:test", root, "category") == [("2937",)]
    assert got(spark, "vggface2:train", root, "category", "split") == [("n000002", "train")]


def test_lists_of_objects(spark, put):
    root = put(**{
        "cc12m.tsv": "http://u/1\ta cup\n", "Kitti/raw/training/label_2/000001.txt": "Car 0.00 0 -1.5 1.5 2 3 4 1.4 1.6 3.7 1 2 30 0.1\n", "Applelogos/apple_applelogos.groundtruth": " 1 2 3 4\n\n",
        "a/1.jpg": "", "b/2.jpg": "", "Food2k_label/train_finetune.txt": "a/1.jpg 17\n", "food2k_names.txt": "17 noodle soup\n", "flowers/f1.jpg": "", "flowers/f2.jpg": "", "flowers/labels.csv": "0,rose\n1,lily\n",
        "annotations.csv": "c.jpg,1,2,3,4,9\n", "classes.txt": "9 Audi TT 2011\n",
        "RASMD_DATASET/rgb/x_12.png": "", "RASMD_DATASET/swir/y_12.png": "", "RASMD_DATASET/swir/y_13.png": "",
    })
    assert got(spark, "cc12m", root, "uri", "captions") == [("http://u/1", ("a cup",))]
    assert got(spark, "kitti", root, "uri", "category", "box") == [("000001.png", "Car", (1.5, 2, 3, 4))]
    assert got(spark, "ethzshapes", root, "uri", "category", "box") == [("apple.jpg", "Applelogos", (1, 2, 3, 4))]
    assert got(spark, "food2k", root, "uri", "category") == [("1.jpg", "noodle soup")]
    assert got(spark, "oxford_flowers_102", f"{root}/flowers", "uri", "category") == [("f1.jpg", "rose"), ("f2.jpg", "lily")]
    assert got(spark, "stanford_cars", root, "category", "box") == [("Audi TT 2011", (1, 2, 3, 4))]
    assert got(spark, "rasmd", root, "number", "path", "path_2") == [(12, "x_12.png", "y_12.png")]


def test_documents(spark, put):
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "coco_url": "http://u/a.jpg"}], "annotations": [{"image_id": 1, "category_id": 9, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 9, "name": "car", "synonyms": ["car", "auto"]}]}
    kin = {"v1": {"url": "u1", "subset": "train", "annotations": {"label": "run", "segment": [1.5, 11.5]}, "duration": 10.0}, "v2": {"subset": "train", "annotations": {"label": "sit", "segment": [0, 10]}}}
    root = put(**{
        "annotations/instances_train2014.json": json.dumps(coco), "lvis_v1_train.json": json.dumps(coco), "2021/val.json": json.dumps(coco), "image_data.json": json.dumps([{"image_id": 1, "url": "u"}, {"image_id": 2, "url": "w"}]),
        "objects.json": json.dumps([{"image_id": 1, "objects": [{"object_id": 5, "names": ["tree", "oak"], "x": 1, "y": 2, "w": 3, "h": 4, "synsets": []}]}]),
        "boxes.csv": "ImageID,Source,LabelName,Confidence,XMin,XMax,YMin,YMax\ni1,x,/m/1,1,0.1,0.2,0.3,0.4\n", "labels.csv": "ImageID,Source,LabelName,Confidence\ni1,x,/m/1,1\ni1,x,/m/2,0\n", "classes.csv": "/m/1,Cat\n/m/2,Dog\n",
        "activity_net.v1-3.min.json": json.dumps({"database": {"v": {"url": "u", "subset": "training", "annotations": [{"label": "run", "segment": [1.0, 2.5]}]}}}), **{f"kinetics{n}/train.json": json.dumps(kin) for n in (400, 600, 700)},
        "TinyVIRAT_V2/tiny_train_v2.json": json.dumps([{"path": "a.mp4", "label": ["walk", "carry"]}]), "TinyVIRAT_V2/tiny_test_v2_public.json": json.dumps([{"path": "b.mp4"}]),
    })
    assert got(spark, "coco", root, "image_id", "category", "box") == [(1, "car", (1, 2, 4, 6))] and got(spark, "coco_classification", root, "category") == [("car",)]
    assert got(spark, "lvis", root, "synonyms") == [(("car", "auto"),)] and got(spark, "inaturalist_2021:val", root, "uri", "category") == [("a.jpg", "car")]
    assert got(spark, "visualgenome", root, "image_id", "category", "tags") == [(1, "tree", ("tree", "oak")), (2, None, None)]
    assert got(spark, "open_images", root, "image_id", "category", "box") == [("i1", "Cat", (0.1, 0.3, 0.2, 0.4))] and got(spark, "open_images:labels", root, "confidences") == [({"Cat": 1.0},)]
    assert got(spark, "activitynet:training", root, "video_id", "startframe", "endframe") == [("v", 30, 75)]
    for name in ("kinetics", "kinetics700", "kinetics600", "kinetics400"):
        assert got(spark, name, root, "uri", "category", "startsec", "endsec") == [("u1", "run", 1.5, 11.5), ("v2", "sit", 0, 10)]
    assert got(spark, "tiny_virat", root, "category", "tags") == [("walk", ("walk", "carry"))] and got(spark, "tiny_virat:test", root, "tags") == [(None,)]


def test_videos(spark, put):
    scene = {"<class 'x.Scene'>": {"filename": "v.mp4", "tracks": {"t": {"id": "t", "label": "car", "framerate": 30.0, "keyframes": [0], "keyboxes": [{"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}]}}, "activities": {"a": {"id": "a", "label": "turns", "startframe": 1, "endframe": 9, "trackid": ["t"]}}}}
    folders = ["cap_classification_clip/annotations", "cap_classification_pad/annotations", "cap_detection_handheld_val/annotations"]
    root = put(**{
        "Charades_v1_train.csv": 'id,subject,scene,quality,relevance,verified,script,objects,descriptions,actions,length\nV1,S,Kitchen,6,7,Yes,"a, ""b""",o,d,c092 11.90 21.20;c147 0.00 12.60,24.8\nV2,S,Hall,6,7,Yes,x,o,d,,9\n',
        "Charades_v1_classes.txt": "c092 Holding a vacuum\nc147 Sitting down\n", "moments_categories.txt": "clapping,0\npraying,1\n", "trainingSet.txt": "a.mp4,1,0\nb.mp4,0\n",
        "ava_train_v2.2.csv": "v,902,0.1,0.2,0.3,0.4,12,0\n", "ava_action_list.csv": "12,stand\n", "yt_bb_detection_train.csv": "v,1099,0,dog,0,present,0.1,0.3,0.2,0.4\nv,2000,0,dog,0,absent,-1.,-1.,-1.,-1.\n",
        "k/a.geom.yml": "- { meta: a }\n- { geom: {id1: 3, id0: 1, ts0: 12, ts1: 0.4, g0: 1 2 3 4, src: truth } }\n- { geom: {id1: 3, id0: 2, ts0: 13, ts1: 0.4, g0: 9 2 3 4, src: truth } }\n", "k/a.types.yml": "- { types: { id1: 3, cset3: { Person: 1.0 } } }\n",
        "k/a.activities.yml": "- { act: { act2: {'person_sits': 1.0}, id2: 5, timespan: [{ tsr0: [10, 20] }], src: truth, actors: [{ id1: 3, timespan: [{ tsr0: [10, 20] }] }] } }\n- { act: { act3: {'person_runs': 1.0}, id2: 6, timespan: [{ tsr0: [1, 2] }], actors: [{ id1: 8 }] } }\n",
        **{f"{f}/s.json": json.dumps(scene) for f in folders}, "pip_175k/pip_175k.json": json.dumps([scene]), "pip_370k_stabilized/p.json": json.dumps([scene, scene]),
    })
    assert got(spark, "charades", root, "video_id", "category", "startframe", "endframe") == [("V1", "Holding a vacuum", 357, 636), ("V1", "Sitting down", 0, 378)]
    assert got(spark, "multimoments", root, "video_id", "category", "endframe") == [("a.mp4", "clapping", 90), ("a.mp4", "praying", 90), ("b.mp4", "clapping", 90)]
    assert got(spark, "ava:train_tracks", root, "video_id", "frame") == [("v", 27060)] and got(spark, "ava:train_activities", root, "category", "startframe", "endframe") == [("stand", 27015, 27105)]
    assert got(spark, "youtubebb", root, "track_id", "frame") == [("dog:0", 32)]
    assert got(spark, "meva_kf1", root, "video_id", "track_id", "category", "frame", "box") == [("a", 3, "Person", 12, (1, 2, 3, 4))]
    assert got(spark, "meva_kf1:activities", root, "video_id", "category", "startframe", "endframe", "track_ids") == [("a", "person_sits", 10, 20, (3,))]
    for name, n in (("cap", 1), ("cap_pad", 1), ("cap_detection", 1), ("pip_175k", 1), ("pip_370k", 2)):
        assert got(spark, name, root, "video_id", "track_id", "frame") == [("v.mp4", "t", 0)] * n, name
        assert got(spark, f"{name}:activities", root, "category", "startframe") == [("turns", 1)] * n


def test_tables(spark, put):
    root = put(**{"labels.txt": "0 apple, pome\n1 bear\n", "coarse.txt": "0 food\n1 animal\n"})
    picture = "struct<bytes:binary,path:string>"
    save = lambda folder, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/{folder}")
    img = (b"x", "p.png")
    for folder in ("train", "test", "valid", "other"):
        save(folder, [(img, 1)], f"image {picture}, label bigint")
    assert got(spark, "mnist", root, "uri", "category", "split") == [("p.png", "1", "train")]
    assert got(spark, "sun397:other", root, "category") == [("bear",)] == got(spark, "tiny_imagenet:val", root, "category")
    save("train", [(img, 8, 0, 1)], f"img {picture}, label bigint, fine_label bigint, coarse_label bigint")
    assert got(spark, "cifar10", root, "category") == [("ship",)] and got(spark, "cifar100", root, "category", "tags") == [("apple", ("apple", "pome", "animal"))]
    save("validation", [(img, 1), (("y".encode(), "q.png"), 0)], f"image {picture}, person bigint")
    assert got(spark, "wakevision:val", root, "category") == [("non-person",), ("person",)]
    save("train", [("u", "t", "d", "c", None), ("w", None, None, "e", "z")], "downloadurl string, title_clean string, description_clean string, text string, caption string")
    assert got(spark, "yfcc100m", root, "uri", "captions") == [("u", ("t", "d")), ("w", ())]
    save("train", [("u", "c")], "url string, text string")
    assert got(spark, "coyo700m", root, "uri", "captions") == [("u", ("c",))] == got(spark, "datacomp_1b", root, "uri", "captions")
    save("train", [("u", "c")], "url string, caption string")
    assert got(spark, "laion2b", root, "captions") == [(("c",),)] == got(spark, "as100m", root, "captions")
    save("test", [("f.jpg", ["a", "b"])], "filename string, caption array<string>")
    assert got(spark, "flickr30k:test", root, "uri", "captions") == [("f.jpg", ("a", "b"))]
    save("test", [("f", "a", "g", "b")], "`image/key` string, IIW string, image_file string, description string")
    assert got(spark, "docci:test", root, "uri", "captions") == [("g", ("b",))]
    save("train", [("u", [1, 0], [0.9, 0.1]), ("w", [1], [0.1])], "url string, labels array<bigint>, label_probs array<double>")
    assert got(spark, "coyo300m", root, "uri", "tags") == [("u", ("bear",)), ("w", ())]
    save("train", [(img, [14], ([14, 11], [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]]))], f"image {picture}, classes array<int>, objects struct<classes:array<int>,bboxes:array<array<double>>>")
    assert got(spark, "pascal", root, "uri", "category", "tags", "box") == [("p.png", "dog", ("person",), (5, 6, 7, 8)), ("p.png", "person", ("person",), (1, 2, 3, 4))]
    save("train", [("a.jpg", [("cup", [1.0, 2.0, 3.0, 4.0])]), ("b.jpg", None)], "image_path string, anns_info array<struct<category:string,bbox:array<double>>>")
    assert got(spark, "objects365", root, "uri", "category", "box") == [("a.jpg", "cup", (1, 2, 3, 4)), ("b.jpg", None, None)]
    save("train", [("i1", "pug", [("dog", [1.0, 2.0, 3.0, 4.0])])], "image_id string, label_breed string, label_bbox_enriched array<struct<label:string,bbox:array<double>>>")
    assert got(spark, "oxford_pets", root, "uri", "category", "tags", "box") == [("i1", "dog", ("pug",), (1, 2, 4, 6))]
    save("train", [(img, 1, (1.0, 2.0, 3.0, 4.0))], f"image {picture}, family bigint, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    assert got(spark, "oxford_fgvc_aircraft", root, "category", "box") == [("bear", (1, 2, 3, 4))]
    for n, rows, schema in (("Faces", [(1, 7)], "face_id bigint, file_id bigint"), ("FaceImages", [(7, "a.jpg")], "file_id bigint, filepath string"), ("FaceRect", [(1, 1.0, 2.0, 3.0, 4.0)], "face_id bigint, x double, y double, w double, h double"), ("FeatureCoords", [(1, 8, 5.0, 6.0)], "face_id bigint, feature_id int, x double, y double"), ("FeatureCoordTypes", [(8, "LeftEyeCenter")], "feature_id int, descr string")):
        save(n, rows, schema)
    assert got(spark, "aflw", root, "uri", "box") == [("data/flickr/a.jpg", (1, 2, 4, 6))]


def test_every_set_has_a_maker():
    assert len(REGISTRY.names()) >= 80
    with pytest.raises(KeyError):
        REGISTRY.get("no such set")
